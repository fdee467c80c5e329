"""Seeded random inputs against plain Python, with many ties, hot keys and several days."""

from __future__ import annotations

import random
from collections import defaultdict
from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from learnlens.functions.gaps import least_gap
from learnlens.operators import activity, summaries, uniqueness
from learnlens.operators.logins import login_course_access
from learnlens.operators.numbering import BY_COURSE_STUDENT, BY_STUDENT, BY_STUDENT_COURSE, number_rows, number_within, splitters, with_block
from learnlens.plans import student
from learnlens.sources.tables import SCHEMAS, LearningTables
from tests.conftest import COURSE_VIEW, LOGIN, ROLES, STUDENT, event

DAY = 86400
AS_OF = 12 * DAY


def tables(spark, courses, enrolments, log, partitions=3):
    given = {
        "course": [(c, f"course {c}", start, end) for c, start, end in courses],
        "context": [(1000 + c, 50, c) for c, _, _ in courses],
        "role": ROLES,
        "role_assignments": [(n, user, 1000 + c, role) for n, (user, c, role) in enumerate(enrolments)],
        "logstore_standard_log": log,
    }
    return LearningTables.from_reader(
        lambda name: spark.createDataFrame(given.get(name, []), SCHEMAS[name]).repartition(partitions)
    )


def random_log(seed, n=600):
    """A third of all rows belongs to user 1 in course 1; times are coarse, so ties are common."""
    rng = random.Random(seed)
    kinds = ["login", "course", "page", "forum", "profile", "discussion", "resource"]
    log = []
    for id in range(1, n + 1):
        user, course = (1, 1) if rng.random() < 0.34 else (rng.randint(1, 4), rng.randint(1, 3))
        kind = rng.choice(kinds)
        time = rng.randint(0, 8) * DAY + rng.choice([0, 5, 5, DAY - 1, rng.randint(0, 40) * 1000])
        log.append(event(id, user, 0 if kind == "login" else course, time, kind))
    return log


COURSES = [(1, 0, 20 * DAY), (2, DAY, 6 * DAY), (3, 0, 0)]
ENROLMENTS = [(u, c, STUDENT) for u in (1, 2, 3) for c in (1, 2, 3)] + [(1, 1, STUDENT)]


def in_window(log, start, end):
    ends = {c: (s, e) for c, s, e in COURSES}
    enrolled = {(u, c) for u, c, _ in ENROLMENTS}
    groups = defaultdict(list)
    for row in log:
        id, user, course, name, component, *_, time = row
        if (user, course) in enrolled and ends[course][0] <= time <= ends[course][1] and start <= time <= end:
            groups[user, course].append((time, id, name, component))
    return {key: sorted(found) for key, found in groups.items()}


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("cap", [1800, 43200])
def test_active_and_object_time(spark, seed, cap):
    log = random_log(seed)
    start = AS_OF - 604800
    active = {(u, c): 0 for u, c, _ in ENROLMENTS}
    objects = dict(active)
    for key, found in in_window(log, start, AS_OF).items():
        for (time, _, name, component), (later, *_) in zip(found, found[1:]):
            if component.startswith("mod_") or name == COURSE_VIEW:
                active[key] += min(later - time, cap)
            if name in activity.LEARNING_OBJECT_VIEWS:
                objects[key] += min(later - time, cap)
    t = tables(spark, COURSES, ENROLMENTS, log)
    got = {(r.student_id, r.course_id): r.active_time_seconds for r in student.student_active_time(t, AS_OF, sessioncap=cap).collect()}
    assert got == active
    got = {(r.student_id, r.course_id): r.learning_object_view_time_seconds for r in student.time_spent_lo(t, AS_OF, sessioncap=cap).collect()}
    assert got == objects


def test_next_event_time(spark):
    log = random_log(4)
    expected = {}
    for found in in_window(log, 0, AS_OF).values():
        for i, (_, id, *_rest) in enumerate(found):
            expected[id] = found[i + 1][0] if i + 1 < len(found) else None
    events = activity.windowed_log(tables(spark, COURSES, ENROLMENTS, log), 0, AS_OF)
    assert {r.event_id: r.next_event_time for r in activity.next_event_time(events).collect()} == expected


@pytest.mark.parametrize("seed", [5, 6])
def test_login_access(spark, seed):
    log = random_log(seed, 900)
    enrolled = {(u, c) for u, c, _ in ENROLMENTS}
    ends = {c: (s, e or AS_OF) for c, s, e in COURSES}
    expected = set()
    for user in (1, 2, 3, 4):
        mine = [(r[8], r[0]) for r in log if r[1] == user and r[3] == LOGIN]
        mine = sorted(mine) + [(float("inf"), 0)]
        for (time, id), (later, _) in zip(mine, mine[1:]):
            for row in log:
                if row[1] == user and row[3] == COURSE_VIEW and time <= row[8] < later and (user, row[2]) in enrolled:
                    if ends[row[2]][0] <= time <= ends[row[2]][1]:
                        expected.add((user, id, row[2]))
    found = login_course_access(tables(spark, COURSES, ENROLMENTS, log), AS_OF)
    got = [(r.student_id, r.login_id, r.course_id) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == expected


def test_result_does_not_depend_on_row_order_or_partitions(spark):
    log = random_log(7)
    results = []
    for partitions in (1, 7):
        random.Random(partitions).shuffle(log)
        t = tables(spark, COURSES, ENROLMENTS, list(log), partitions)
        results.append([tuple(r) for r in student.student_active_time(t, AS_OF).collect()])
    assert results[0] == results[1]


def test_capped_time_is_at_most_cap_per_event(spark):
    log = random_log(8)
    t = tables(spark, COURSES, ENROLMENTS, log)
    seconds = activity.activity_seconds(t, 0, AS_OF)
    totals = {(r.student_id, r.course_id): r.total for r in activity.capped_totals(seconds, 7, least_gap, 60).collect()}
    counts = defaultdict(int)
    for row in log:
        counts[row[1], row[2]] += 1
    assert all(total <= 60 * counts[key] for key, total in totals.items())


def test_days_bound_every_window(spark):
    """The hot pair is cut into days before any window sees it."""
    log = [event(i, 1, 1, i % (3 * DAY)) for i in range(3000)]
    t = tables(spark, [(1, 0, 20 * DAY)], [(1, 1, STUDENT)], log)
    sizes = activity.activity_seconds(t, 0, AS_OF).groupBy("student_id", "course_id", "day").count()
    assert sizes.agg(F.max("count")).collect()[0][0] <= DAY


# -- shared passes


def busy_log(seed, n=500):
    """Many events in the same seconds, assignment views and submissions among them; some without module, user or object."""
    rng = random.Random(seed)
    kinds = ["login", "course", "page", "forum", "assign", "assign", "submit", "discussion", "profile"]
    log = []
    for id in range(1, n + 1):
        kind = rng.choice(kinds)
        row = list(event(id, rng.choice([1, 1, 2, 3, 4, None]), 0 if kind == "login" else rng.randint(1, 3), rng.randint(0, 6) * DAY + rng.choice([0, 1, 2, 3, DAY - 1]), kind))
        row[6], row[7] = rng.choice([None, 1, 2, 3]), rng.choice([None, 1, 2])
        log.append(tuple(row))
    return log


def test_indicators_from_shared_passes(spark):
    t = tables(spark, COURSES, ENROLMENTS, busy_log(1))
    seen = 0
    for indicator, spec in student.STUDENT_INDICATORS.items():
        ranges = ("weekly", "yearly") if spec.in_hours else (None,)
        for time_range in ranges:
            rows = [
                sorted(map(tuple, student.student_rows(t, indicator, student.StudentParams(AS_OF, time_range=time_range, sessioncap=90_000, shared=shared), None).collect()))
                for shared in (False, True)
            ]
            assert rows[0] == rows[1], indicator
            seen += sum(r[-1] > 0 for r in rows[0])
    assert seen > 40


# -- day summaries


@pytest.mark.parametrize("as_of", [8 * DAY, 6 * DAY - 1, 5 * DAY + 12_345])
def test_refresh_from_day_summaries(spark, tmp_path, as_of):
    """Stored in two steps, the second with the new days only; every period, whether it begins and ends at midnight, just before, or inside a day."""
    t = tables(spark, COURSES, ENROLMENTS, busy_log(3, 400))
    cap, today = 30_000, as_of // DAY
    summaries.day_summaries(t, 0, today // 2, cap).write.parquet(f"{tmp_path}/days")
    summaries.day_summaries(t, today // 2, today, cap).write.mode("append").parquet(f"{tmp_path}/days")
    stored = spark.read.parquet(f"{tmp_path}/days")
    assert stored.count() == stored.select("student_id", "course_id", "day").distinct().count()
    for period in ("hourly", "daily", "weekly", "monthly", "yearly"):
        window = student.StudentParams(as_of, time_range=period).window
        seconds = activity.activity_seconds(t, *window)
        days = summaries.period_days(t, stored, *window, cap)
        each = [activity.capped_totals(seconds, b, least_gap, cap).withColumn("kind", F.lit(n)) for b, n in summaries.TOTALS.items()]
        raw = {(r.kind, r.student_id, r.course_id): (r.total or 0, r.saw_forum) for r in reduce(DataFrame.unionByName, each).collect()}
        got = summaries.merged_totals(days, cap).collect()
        assert {(n, r.student_id, r.course_id): (r[n], r.saw_forum) for r in got for n in summaries.TOTALS.values()} == raw, period


# -- row numbers


ORDERS = (BY_COURSE_STUDENT, BY_STUDENT_COURSE)


def numbered(df, keys, **options):
    """The keys in the order of their numbers, which must be 1, 2, .."""
    rows = sorted(number_rows(df, keys, "n", **options).collect(), key=lambda r: r.n)
    assert [r.n for r in rows] == list(range(1, len(rows) + 1))
    return [tuple(r[k] for k in keys) for r in rows]


@pytest.mark.parametrize("keys", ORDERS)
@pytest.mark.parametrize("most", [1, 20, 4096])
def test_row_numbers_cross_blocks(spark, keys, most):
    """With few rows in a block, one block, or a splitter for every row."""
    rng = random.Random(9)
    pairs = {(rng.choice([1, 2, 3]), rng.randint(0, 400_000)) for _ in range(600)}
    df = spark.createDataFrame([(s, c) for c, s in pairs], "student_id long, course_id long").repartition(5)
    got = numbered(df, keys, most=most)
    assert got == sorted(got) and len(got) == len(pairs)


@pytest.mark.parametrize("keys", [*ORDERS, BY_STUDENT])
def test_row_numbers_of_spread_ids(spark, keys):
    """Ids over all 64 bits, negative ones too."""
    rng = random.Random(10)
    ids = [rng.randint(-(2**63), 2**63 - 1) for _ in range(120)] + [-1, 0, 1, -65536, 65536, -(2**63), 2**63 - 1]
    pairs = {(s, rng.choice(ids[:5] + [0, -1])) for s in ids}
    df = spark.createDataFrame(list(pairs), "student_id long, course_id long").repartition(3)
    expected = sorted(tuple(dict(zip(("student_id", "course_id"), p))[k] for k in keys) for p in pairs)
    for most in (30, 4096):
        assert numbered(df, keys, most=most) == expected
    assert numbered(df.limit(0), keys) == [] and len(numbered(df.limit(1), keys)) == 1


def test_blocks_of_a_skewed_table_are_even(spark):
    """One course owns most rows, and its students' ids are dense; the other ids are spread over all 64 bits."""
    rows = spark.range(60_000).selectExpr("if(id % 10 < 9, 7, xxhash64(id)) course_id", "if(id % 10 < 9, id, xxhash64(id, 1)) student_id")
    for most in (64, 1000):
        sizes = [r["count"] for r in with_block(rows, BY_COURSE_STUDENT, splitters(rows, BY_COURSE_STUDENT, most), most).groupBy("__block").count().collect()]
        assert len(sizes) == most and sum(sizes) == 60_000 and max(sizes) < 60_000 / most * 12


def test_numbers_within_groups(spark):
    rng = random.Random(12)
    rows = list({(rng.randint(1, 3), rng.randint(-200_000, 200_000)) for _ in range(400)})
    df = spark.createDataFrame(rows, "g long, k long").repartition(3)
    got = {(r.g, r.k): (r.n, r.all) for r in number_within(df, ["g"], "k", "n", total="all").collect()}
    for g in (1, 2, 3):
        own = sorted(k for h, k in rows if h == g)
        assert [got[g, k] for k in own] == [(i, len(own)) for i in range(1, len(own) + 1)]


# -- feedback overlap


def brute_overlaps(records):
    texts = defaultdict(list)
    for assignment, key, text in records:
        texts[assignment].append((key, text.split(" ")))
    best = {}
    for assignment, found in texts.items():
        for key, own in found:
            best[assignment, key] = max(
                (sum(w in set(other) for w in own) for k, other in found if k != key), default=0
            )
    return best


def random_records(seed):
    """Common words, templates, copies, repeated words and one assignment with most records."""
    rng = random.Random(seed)
    common = ["the", "a", "work", "good", "", "please"]
    rare = [f"w{i}" for i in range(60)]
    endings = ["please review the rubric", "keep it up", ""]
    records = []
    for key in range(1, 91):
        assignment = 1 if rng.random() < 0.6 else rng.randint(2, 5)
        body = [rng.choice(common if rng.random() < 0.4 else rare) for _ in range(rng.randint(0, 12))]
        records.append((assignment, key, " ".join([*body, rng.choice(endings)])))
        if rng.random() < 0.1:
            records.append((assignment, 1000 + key, records[-1][2]))
    return records


def texts_of(spark, records):
    """Different texts with their copies, as the search takes them."""
    keys = defaultdict(list)
    for assignment, key, text in records:
        keys[assignment, text].append(key)
    rows = [(a, min(k), len(k), len(t.split(" ")), t.split(" ")) for (a, t), k in keys.items()]
    return spark.createDataFrame(rows, "assignment_id long, text_id long, copies long, n_words int, words array<string>")


@pytest.fixture(params=["looked up", "in tiles"])
def search(request, monkeypatch):
    """Both ways of finding better partners; without the setting these small inputs would use look-ups only."""
    if request.param == "in tiles":
        monkeypatch.setattr(uniqueness, "LOOKUPS", 0)
        monkeypatch.setattr(uniqueness, "TILE", 20)
        monkeypatch.setattr(uniqueness, "_COLUMNS", 16)


@pytest.mark.parametrize("seed", [11, 12])
def test_overlaps_equal_pairwise_comparison(spark, search, seed):
    records = random_records(seed)
    lengths = {(a, k): len(text.split(" ")) for a, k, text in records}
    expected = brute_overlaps(records)
    got = {(r.assignment_id, r.text_id): r.overlap for r in uniqueness.largest_overlaps(texts_of(spark, records)).collect()}
    copies = {key for key in expected if key not in got}
    assert all(expected[key] == lengths[key] for key in copies)
    assert {key: expected[key] for key in got} == got


@pytest.mark.parametrize("goal", [0.0, 33.3, 50.0, 60.0, 100.0])
def test_goal_search_decides_like_the_exact_one(spark, search, goal):
    records = random_records(14)
    expected = brute_overlaps(records)
    got = {(r.assignment_id, r.text_id): r.overlap for r in uniqueness.largest_overlaps(texts_of(spark, records), goal).collect()}
    lengths = {(a, k): len(text.split(" ")) for a, k, text in records}
    for key, overlap in got.items():
        assert (1.0 - overlap / lengths[key] < goal / 100) == (1.0 - expected[key] / lengths[key] < goal / 100)


@pytest.mark.parametrize("goal", [20.0, 60.0, 80.0])
@pytest.mark.parametrize("widest", [1, 3])
def test_texts_that_the_widest_leave_open_are_searched(spark, search, monkeypatch, goal, widest):
    monkeypatch.setattr(uniqueness, "WIDE", widest, raising=False)
    monkeypatch.setattr(uniqueness, "CHUNK", 100, raising=False)
    test_goal_search_decides_like_the_exact_one(spark, search, goal)


def test_words_of_decided_texts_are_no_rows(spark, monkeypatch):
    """Texts of one small vocabulary are decided by the widest: a few rows each are staged, and no row per word."""
    rng = random.Random(15)
    records = [(1, key, " ".join(rng.choice([f"w{i}" for i in range(80)]) for _ in range(60))) for key in range(200)]
    staged = []

    def stage(df):
        kept = df.localCheckpoint()
        staged.append(kept.count())
        return kept

    monkeypatch.setattr(uniqueness, "stage", stage)
    found = uniqueness.largest_overlaps(texts_of(spark, records), 60.0).collect()
    assert len(found) == 200 and all(r.overlap >= 30 for r in found)
    assert sum(staged) <= 3 * len(records)


@pytest.mark.parametrize("goal", [None, 20.0])
def test_words_of_open_texts_are_no_rows(spark, monkeypatch, goal):
    """Also texts that the widest leave open are searched as one row each: no row per word is staged or shuffled."""
    rng = random.Random(16)
    records = [(1, key, " ".join(rng.choice([f"w{i}" for i in range(80)]) for _ in range(60))) for key in range(200)]
    staged = []

    def stage(df):
        kept = df.localCheckpoint()
        staged.append(kept.count())
        return kept

    monkeypatch.setattr(uniqueness, "stage", stage)
    found = uniqueness.largest_overlaps(texts_of(spark, records), goal)
    got = {(r.assignment_id, r.text_id): r.overlap for r in found.collect()}
    assert got == brute_overlaps(records)  # none reaches a goal of 20 by the widest, so all are exact
    assert sum(staged) <= 3 * len(records)
    exchanges = [x for x in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in x]
    assert exchanges and not any("word#" in x or "code#" in x for x in exchanges)


@pytest.mark.parametrize("words", [100, 700])
def test_blocks_meet_in_pairs(spark, monkeypatch, words):
    monkeypatch.setattr(uniqueness, "CHUNK", words)
    monkeypatch.setattr(uniqueness, "WIDE", 2)
    records = [x for x in random_records(17) if x[0] == 1]
    got = {(r.assignment_id, r.text_id): r.overlap for r in uniqueness.largest_overlaps(texts_of(spark, records)).collect()}
    expected = brute_overlaps(records)
    assert len(got) > 1 and {key: expected[key] for key in got} == got
