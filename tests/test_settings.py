"""Settings, periods, registry, dashboard and refresh."""

from datetime import datetime, timezone

import gc
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from learnlens.functions import staging
from learnlens.functions.periods import TimeRange, reporting_window
from learnlens.functions.staging import stage
from learnlens.operators.roster import course_ids_of, user_courses
from learnlens.plans.dashboard import dashboard, refresh
from learnlens.plans.registry import INDICATORS, STUDENT, TEACHER, indicators_of, params_for_filter
from learnlens.plans.series import bar_series, state_counts
from learnlens.plans.settings import resolve_setting
from learnlens.plans.student import StudentParams
from learnlens.sources.tables import conform
from tests.conftest import STUDENT as STUDENT_ROLE
from tests.conftest import TEACHER as TEACHER_ROLE
from tests.conftest import event, rows

AS_OF = 1_000_000


def epoch(*parts):
    return int(datetime(*parts, tzinfo=timezone.utc).timestamp())


@pytest.mark.parametrize(
    ("name", "configured", "expected"),
    [
        ("feedbackgoal", 140, 60.0), ("feedbackgoal", "35", 35.0), ("feedbackgoal", None, 60.0), ("feedbackgoal", "x", 60.0),
        ("timelyfeedbackdays", "3.9", 3), ("timelyfeedbackdays", 32, 8), ("sessioncap", 59, 1800), ("sessioncap", 86400, 86400),
        ("interactionthreshold", -1, 5.0), ("gradethreshold", "nan", 70.0), ("sessioncap", "inf", 1800),
    ],
)
def test_settings_are_replaced_not_clamped(name, configured, expected):
    value = resolve_setting(name, configured)
    assert value == expected and type(value) is type(expected)


def test_unknown_setting():
    with pytest.raises(KeyError):
        resolve_setting("nothing")


@pytest.mark.parametrize(
    ("period", "start"),
    [("hourly", AS_OF - 3600), ("daily", AS_OF - 86400), ("weekly", AS_OF - 604800), (None, AS_OF - 604800)],
)
def test_fixed_periods(period, start):
    assert reporting_window(period, AS_OF) == (start, AS_OF)


def test_calendar_periods():
    assert reporting_window("monthly", epoch(2024, 3, 31, 12))[0] == epoch(2024, 3, 2, 12)
    assert reporting_window("monthly", epoch(2023, 3, 31, 12))[0] == epoch(2023, 3, 3, 12)
    assert reporting_window("monthly", epoch(2024, 1, 15))[0] == epoch(2023, 12, 15)
    assert reporting_window("yearly", epoch(2024, 2, 29))[0] == epoch(2023, 3, 1)
    # Same wall time in the zone across a change of summer time: 14:00 there is 18:00, then 19:00 UTC.
    assert reporting_window("monthly", epoch(2024, 3, 20, 18), "America/Halifax")[0] == epoch(2024, 2, 20, 19)


def test_unknown_period():
    with pytest.raises(ValueError):
        reporting_window("fortnightly", AS_OF)


def test_registry():
    assert len(INDICATORS) == 13
    assert len(indicators_of(TEACHER)) == 5 and len(indicators_of(STUDENT)) == 8
    assert [d.id for d in INDICATORS.values() if d.student_success] == [
        "course_performance_feedback", "personalized_feedback", "student_active_time", "time_spent_forums",
        "forum_posting_frequency", "time_spent_lo", "number_forums_viewed",
    ]
    assert INDICATORS["student_active_time"].defaults({"sessioncap": 60}) == {"time_range": "weekly", "sessioncap": 60}
    assert INDICATORS["timely_feedback"].defaults() == {"days": 8}
    assert params_for_filter("time_spent_lo", "daily") == {"time_range": "daily", "sessioncap": 1800}
    assert INDICATORS["time_spent_lo"].control["options"] == [p.value for p in TimeRange]
    for wrong in (("time_spent_lo", "never"), ("timely_feedback", "daily")):
        with pytest.raises(ValueError):
            params_for_filter(*wrong)
    with pytest.raises(KeyError):
        params_for_filter("nothing", "daily")


def test_course_ids():
    assert course_ids_of(["3", 3, 1]) == [3, 1]
    for wrong in ([], [0], [1, "0"]):
        with pytest.raises(ValueError):
            course_ids_of(wrong)


def test_refresh(spark, world):
    log = [event(1, 7, 1, AS_OF - 90_000, "page"), event(2, 7, 1, AS_OF - 86_200, "page"), event(3, 7, 1, AS_OF - 86_000, "page")]
    t = world([(1, 0, 2 * AS_OF)], [(7, 1, STUDENT_ROLE)], logstore_standard_log=log)
    weekly = refresh(spark, t, "student_active_time", [1, 1], "weekly", AS_OF)
    daily = refresh(spark, t, "student_active_time", [1], "daily", AS_OF)
    assert rows(weekly, "position", "label", "value") == [(1, "7", 1)]
    assert rows(daily, "position", "label", "value") == [(1, "7", 1)]
    hourly = refresh(spark, t, "student_active_time", [1], "hourly", AS_OF)
    assert rows(hourly, "value") == [(0,)]
    with pytest.raises(ValueError):
        refresh(spark, t, "student_active_time", [], "daily", AS_OF)


def test_state_counts_keep_zeros(spark):
    states = spark.createDataFrame([("Exhibited",), ("Exhibited",)], "state string")
    assert rows(state_counts(spark, states), "position", "label", "value") == [
        (1, "Exhibited", 2), (2, "Not Exhibited", 0), (3, "Not Required", 0),
    ]


def test_bars_repeat_labels_and_are_not_cut(world):
    log = [event(i, 7, c, AS_OF - 400_000 + i * 86_400, "page") for c in (1, 2) for i in range(3)]
    t = world([(1, 0, 2 * AS_OF), (2, 0, 2 * AS_OF)], [(7, 1, STUDENT_ROLE), (7, 2, STUDENT_ROLE)], logstore_standard_log=log)
    bars = bar_series(t, "student_active_time", StudentParams(AS_OF, sessioncap=86_400))
    assert rows(bars, "position", "label", "value") == [(1, "7", 48), (2, "7", 48)]


def test_dashboard_without_data(spark, world):
    t = world([(1, 0, 2 * AS_OF)], [(7, 1, STUDENT_ROLE)])
    found = {r.indicator_id: (r.has_data, r.position) for r in dashboard(spark, t, AS_OF, group=TEACHER).collect() if not r.has_data}
    assert set(found) == {"course_performance_feedback", "monitoring_forums", "consistent-use-lms"}
    assert all(position is None for _, position in found.values())
    students = dashboard(spark, t, AS_OF, group=STUDENT).collect()
    assert [r.indicator_id for r in students if not r.has_data] == ["time_spent_forums"]
    assert dashboard(spark, t, AS_OF, course_ids=[], group=STUDENT).count() == 0


def test_course_picker(world):
    t = world([(1, 0, 9), (2, 0, 9)], [(7, 1, STUDENT_ROLE), (7, 1, TEACHER_ROLE), (7, 2, STUDENT_ROLE), (8, 2, STUDENT_ROLE)])
    picker = user_courses(t, selected_ids=[2], user_ids=[7])
    assert rows(picker, "user_id", "course_id", "course_name", "selected") == [(7, 1, "course 1", False), (7, 2, "course 2", True)]


def test_tables_are_checked(spark):
    with pytest.raises(ValueError, match="lacks column"):
        conform(spark.createDataFrame([(1,)], "id long"), "assign")
    with pytest.raises(ValueError, match="expected bigint"):
        conform(spark.createDataFrame([(1, "x")], "id long, course string"), "assign")


def staged_files(spark):
    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    return [p for p in folder.rglob("part-*") if p.is_file()]


def test_staged_results_go_to_the_named_folder_and_leave_nothing(spark):
    """Files go once their result is out of use, as a session of this library deletes them."""
    gc.collect()
    before = set(staged_files(spark))
    staged = stage(spark.range(5))
    assert staged.count() == 5 and set(staged_files(spark)) - before
    del staged
    for _ in range(40):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        if not set(staged_files(spark)) - before:
            return
        time.sleep(0.25)
    raise AssertionError("staged files were left")


def test_staging_leaves_no_shuffle_files(spark):
    """They go at once, while the staged result and its source are in use, and the setting is as before."""
    files = lambda: {x for x in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if "shuffle_" in x}
    setting = spark.conf.get(staging.CLEAN_SHUFFLES, None)
    before = files()
    source = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    staged = stage(source)
    for _ in range(40):
        if not files() - before:
            break
        time.sleep(0.25)
    assert not files() - before
    assert staged.count() == source.count() == 7
    assert spark.conf.get(staging.CLEAN_SHUFFLES, None) == setting


@pytest.mark.parametrize("master,one", [("local", True), ("local[*]", True), ("local-cluster[2,1,1024]", False), ("spark://x:7077", False), ("yarn", False)])
def test_only_one_machine_may_stage_below_its_warehouse(master, one):
    assert staging.is_one_machine(master) == one
