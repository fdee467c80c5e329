"""What the physical plans must and must not contain."""

import re

import pytest

from learnlens.functions.periods import DAY
from learnlens.operators import activity, assessment, forum, summaries, uniqueness, weekly
from learnlens.plans import catalog, student, teacher
from learnlens.plans.dashboard import dashboard
from learnlens.plans.registry import STUDENT, TEACHER
from learnlens.sources.sample import AS_OF, sample_tables
from learnlens.sources.tables import SCHEMAS, LearningTables, store_log_by_day

ROOT = "/root/testdata/sf0.001"
QUERIES = catalog.queries()


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    folder = tmp_path_factory.mktemp("tables")
    derived = sample_tables(spark, ROOT)
    for name in SCHEMAS:
        getattr(derived, name).write.parquet(f"{folder}/{name}.parquet")
    return LearningTables.from_parquet(spark, str(folder))


# One name per plan shape. The staged searches run jobs while they are built; the oracle tests cover those.
VARIANTS = ("_refresh_", "hourly", "daily", "weekly", "yearly", "monthly", "_cap", "_counts", "threshold_", "days_")
STAGED = ("personalized", "feedback_uniqueness", "dashboard", "teacher_events", "resolved_chains", "monitoring_forums")
SHAPES = [n for n in QUERIES if not any(part in n for part in VARIANTS + STAGED) or n == "weekly_interactions"]


@pytest.mark.parametrize("name", SHAPES)
def test_no_cross_joins_and_no_python(spark, name):
    text = plan(QUERIES[name](spark, ROOT))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Scan ExistingRDD"):
        assert operator not in text, operator


def log_scans(text: str) -> list[str]:
    return [line for line in text.splitlines() if "FileScan" in line and "timecreated" in line and "eventname" in line]


def test_log_filters_reach_the_scan(stored):
    scans = log_scans(plan(student.student_active_time(stored, AS_OF, course_ids=[1, 2])))
    assert scans
    for scan in scans:
        assert f"GreaterThanOrEqual(timecreated,{AS_OF - 604800})" in scan
        assert f"LessThanOrEqual(timecreated,{AS_OF})" in scan
        assert "In(courseid, [1,2])" in scan
        read = re.search(r"ReadSchema: struct<([^>]*)", scan).group(1)
        assert "objectid" not in read and "contextinstanceid" not in read


def test_event_names_reach_the_scan(stored):
    for scan in log_scans(plan(student.lo_access_frequency(stored))):
        assert "In(eventname" in scan


def test_no_single_task_over_events(stored):
    seconds = activity.activity_seconds(stored, 0, AS_OF)
    totals = activity.capped_totals(seconds, activity.ACTIVE, student.gap_or_null, 1800)
    assert "SinglePartition" not in plan(totals)
    assert "SinglePartition" not in plan(teacher.timely_feedback(stored))
    assert "SinglePartition" not in plan(forum.member_posts(stored))
    # The first and last second of all courses are two small aggregates of the course table.
    weeks = plan(teacher.consistent_use_lms(stored, AS_OF))
    singles = [part.splitlines()[1] for part in weeks.split("Exchange SinglePartition")[1:]]
    assert all("partial_min(course_start" in x or "partial_collect_list(struct(word" in x for x in singles)


def test_students_rows_meet_no_shuffle(spark, stored):
    """With broadcasts off, the log's rows pass the bitmap of the teachers below the first exchange."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = fixed_plan(spark, lambda: weekly.weekly_interactions(stored, AS_OF))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = text.splitlines()
    scan = next(i for i, x in enumerate(lines) if "FileScan" in x and "logstore_standard_log" in x)
    above = lines[:scan][::-1]
    column = lines[scan].index("FileScan") - 3
    # upwards from the scan, the operators of its own branch
    branch = [x for x in above if x[:column].strip(" :") == "" or x.lstrip(" :").startswith("+-")]
    bits = next(i for i, x in enumerate(branch) if "getbit(" in x)
    shuffled = next(i for i, x in enumerate(branch) if "Exchange hashpartitioning(userid" in x)
    assert bits < shuffled
    assert sum("FileScan" in x and "logstore_standard_log" in x for x in lines) == 1


def test_only_follow_ups_are_searched(spark, stored):
    """One scan reads messages; its filter asks the follow-ups' bitmap before the keywords, and all else reads keys only."""
    text = fixed_plan(spark, lambda: forum.resolved_chains(stored))
    reading = [x for x in text.splitlines() if "FileScan" in x and "message" in x]
    searching = [x for x in text.splitlines() if "Contains" in x and "FileScan" not in x]
    assert len(reading) == 1 and len(searching) == 1
    assert searching[0].index("getbit(") < searching[0].index("Contains(")
    assert not any("Exchange" in x and "message" in x for x in text.splitlines())


def test_teacher_events_scan_the_log_once(stored):
    """While it is built: both parts of its plan read what is staged then."""
    text = plan(activity.teacher_events(stored, AS_OF))
    assert "logstore_standard_log" not in text and "Scan ExistingRDD" in text


def test_only_teachers_events_are_counted(stored):
    text = plan(teacher.consistent_use_lms(stored, AS_OF))
    assert "Join" in text[text.index("partial_count(1)"):]


def test_events_are_aggregated_before_they_are_shuffled(stored):
    text = plan(activity.activity_seconds(stored, 0, AS_OF))
    exchange = text.index("Exchange hashpartitioning(userid")
    assert "partial_max_by" in text[exchange:]


def test_no_text_is_shuffled_for_forum_posts(stored):
    for line in plan(teacher.monitoring_forums(stored)).splitlines():
        assert not ("Exchange" in line and "message" in line)


def test_no_text_is_shuffled_for_low_grades(spark, stored):
    """Comments are searched below every shuffle, and another course's comments not at all."""
    for course_ids in (None, [1, 2]):
        lines = fixed_plan(spark, lambda: teacher.course_performance_feedback(stored, course_ids)).splitlines()
        assert not any("Exchange" in x and "commenttext" in x for x in lines)
        searching = [x for x in lines if "RLIKE" in x and "FileScan" not in x]
        assert len(searching) == 1 and ("getbit(" in searching[0]) == (course_ids is not None)


def test_comments_without_a_graded_row_go_before_any_shuffle(spark, stored):
    """Also where nothing is broadcast: the texts of the records, and those read again for the words."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        records = fixed_plan(spark, lambda: assessment.feedback_records(stored))
        kept = uniqueness._records(stored, assessment.graded_submissions(stored)).localCheckpoint()
        texts = fixed_plan(spark, lambda: uniqueness._texts(stored, kept))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for text in (records, texts):
        lines = text.splitlines()
        scan = next(i for i, x in enumerate(lines) if "FileScan" in x and "commenttext" in x)
        exchange = max(i for i, x in enumerate(lines[:scan]) if "Exchange" in x)
        assert any("Filter" in x and "getbit(" in x for x in lines[exchange:scan])
        assert not any("Project" in x and "split(" in x for x in lines[exchange:scan])


def test_dashboard_compares_texts_before_its_own_job(spark, stored):
    """Texts are compared while it is built, so that their shuffle is gone when the series are computed; its plan reads what is staged."""
    text = plan(dashboard(spark, stored, AS_OF, configured={"feedbackgoal": 40.0}, group=TEACHER))
    assert "Scan ExistingRDD" in text
    assert "CoGroup" not in text and "explode(codes" not in text


def test_stored_tables_give_the_same_result(spark, stored):
    derived = sample_tables(spark, ROOT)
    for t in (derived, stored):
        result = [tuple(r) for r in student.student_active_time(t, AS_OF).collect()]
        assert len(result) == 36
    assert result == [tuple(r) for r in student.student_active_time(derived, AS_OF).collect()]


def fixed_plan(spark, build) -> str:
    """The plan without adaptive execution, which shows shared shuffles before the run."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return plan(build())
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_numbering_an_aggregate_reads_the_log_once(spark, stored):
    assert len(log_scans(fixed_plan(spark, lambda: student.time_spent_forums(stored, AS_OF)))) == 1


def test_summaries_bound_the_scan(spark, stored, tmp_path):
    """New days only when they are extended; at a refresh only what lies before the first and after the last whole day."""
    summaries.day_summaries(stored, 19_000, AS_OF // DAY, 1800).write.parquet(f"{tmp_path}/days")
    (scan,) = log_scans(fixed_plan(spark, lambda: summaries.day_summaries(stored, 19_751, 19_753, 1800)))
    assert f"GreaterThanOrEqual(timecreated,{19_751 * DAY})" in scan and f"LessThanOrEqual(timecreated,{19_753 * DAY - 1})" in scan
    days, noon = spark.read.parquet(f"{tmp_path}/days"), AS_OF - DAY // 2
    plans = fixed_plan(spark, lambda: student.student_active_time(stored, noon, time_range="monthly", summaries=days))
    (scan,) = log_scans(plans)
    start = student.StudentParams(noon, time_range="monthly").window[0]
    for bound in (f"GreaterThanOrEqual(timecreated,{start})", f"LessThanOrEqual(timecreated,{(start // DAY + 1) * DAY - 1})", f"GreaterThanOrEqual(timecreated,{AS_OF - DAY})", f"LessThanOrEqual(timecreated,{noon})"):
        assert bound in scan
    assert "Or(And(" in scan and "last_kind" in plans


@pytest.fixture(scope="module")
def by_day(spark, stored, tmp_path_factory):
    """The stored tables with the log by day, written in two steps."""
    folder = tmp_path_factory.mktemp("by_day")
    for name in SCHEMAS:
        if name != "logstore_standard_log":
            getattr(stored, name).write.parquet(f"{folder}/{name}.parquet")
    log, path = stored.logstore_standard_log, f"{folder}/logstore_standard_log.parquet"
    store_log_by_day(log.filter(f"timecreated < {AS_OF - 5 * DAY}"), path, 2)
    store_log_by_day(log.filter(f"timecreated >= {AS_OF - 5 * DAY}"), path, mode="append")
    return LearningTables.from_parquet(spark, str(folder), log_by_day=True)


def test_a_log_by_day_gives_the_same_results(stored, by_day):
    assert by_day.logstore_standard_log.drop("log_day").exceptAll(stored.logstore_standard_log).isEmpty()
    for build in (
        lambda t: student.student_active_time(t, AS_OF),
        lambda t: student.time_spent_assignments(t, AS_OF, time_range="monthly"),
        lambda t: student.login_frequency(t, AS_OF),
        lambda t: weekly.weekly_interactions(t, AS_OF),
        lambda t: activity.windowed_log(t, AS_OF - DAY, AS_OF),
        lambda t: student.time_spent_lo(t, AS_OF - 999, summaries=summaries.day_summaries(t, 0, AS_OF // DAY - 1, 1800)),
    ):
        results = [sorted(map(tuple, build(t).collect())) for t in (stored, by_day)]
        assert results[0] == results[1] and results[0]


def test_time_bounds_choose_folders(by_day):
    scan = next(x for x in plan(student.student_active_time(by_day, AS_OF)).splitlines() if "FileScan" in x and "timecreated" in x)
    chosen = re.search(r"PartitionFilters: \[([^\]]*)", scan).group(1)
    assert f">= {AS_OF // DAY - 7})" in chosen and f"<= {AS_OF // DAY})" in chosen
    # the span of the courses, known at run time
    scan = next(x for x in plan(teacher.consistent_use_lms(by_day, AS_OF)).splitlines() if "FileScan" in x and "timecreated" in x)
    assert "PartitionFilters: [isnotnull(log_day" in scan and "ubquery" in scan[scan.index("PartitionFilters"):scan.index("PushedFilters")]


def exchanges(spark, build) -> int:
    """Shuffles of a plan, those that it shares counted once."""
    return sum(bool(re.search(r"(?<!Reused)Exchange (hash|range|Single|Round)", x)) for x in fixed_plan(spark, build).splitlines() if "ReusedExchange" not in x)


@pytest.mark.parametrize("indicator", [n for n, spec in student.STUDENT_INDICATORS.items() if spec.record_order])
def test_numbers_cost_few_shuffles(spark, stored, indicator):
    """One of the rows, the others of at most 4096 rows; no Python, no join."""
    p = student.StudentParams(AS_OF)
    build = lambda order: student.student_rows(stored, indicator, p, order)
    order = student.STUDENT_INDICATORS[indicator].record_order
    assert 0 < exchanges(spark, lambda: build(order)) - exchanges(spark, lambda: build(None)) <= 4


def test_dashboard_reads_the_log_once_per_kind_of_event(spark, stored):
    """What happened in the period, and what counts for all time: one scan each, whatever the number of series."""
    text = fixed_plan(spark, lambda: dashboard(spark, stored, AS_OF, group=STUDENT))
    # by the file's name, as the scan of views reads no time
    assert len([line for line in text.splitlines() if "FileScan" in line and "logstore_standard_log" in line]) == 2


def test_dashboard_joins_grades_once(spark, stored):
    """Its pies read what is staged; comments are still read by both that search them."""
    text = fixed_plan(spark, lambda: dashboard(spark, stored, AS_OF, group=TEACHER))
    scans = [x for x in text.splitlines() if "FileScan" in x]
    assert not any("assign_submission.parquet" in x or "assign_grades.parquet" in x for x in scans)


def test_dashboard_searches_comments_on_low_grades_only(spark, stored):
    """The bitmap of the low grades comes before the keyword search, in every filter that searches."""
    text = fixed_plan(spark, lambda: dashboard(spark, stored, AS_OF, group=TEACHER))
    searching = [x for x in text.splitlines() if "RLIKE" in x and "Filter" in x and "FileScan" not in x]
    assert searching and all(0 <= x.find("getbit(") < x.find("RLIKE") for x in searching)
