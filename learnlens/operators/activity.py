"""Time on the platform: clipped log events, next-event gaps and capped totals.

A (student, course) pair may own a large share of the log, so no window is ever partitioned by that pair over raw
events. Only the last event of a second can have a positive gap, hence events are first reduced to one row per
(student, course, second) with map-side partial aggregation. Gaps are then taken inside (student, course, day),
at most 86400 rows, and one row per day carries the gap across midnight.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from learnlens.functions.periods import DAY
from learnlens.functions.staging import stage
from learnlens.operators.membership import key_bitmap, may_hold
from learnlens.operators.roster import course_roster, course_windows, in_courses, teacher_roster
from learnlens.sources.tables import LearningTables, between_times

COURSE_VIEWED = r"\core\event\course_viewed"
LEARNING_OBJECT_VIEWS = tuple(
    rf"\mod_{module}\event\course_module_viewed" for module in ("resource", "url", "page", "lesson")
)

# Bits of an event's kind.
ACTIVE, FORUM_VIEW, LEARNING_OBJECT_VIEW = 1, 2, 4
ANY_FORUM_VIEW = 8

Gap = Callable[[Column, Column, int], Column]


def _flag(condition: Column, bit: int) -> Column:
    return F.when(condition, bit).otherwise(0)


def event_kind() -> Column:
    """Bit set: counts as active (a `mod_%` component or a course view), is a forum view, is an object view."""
    active = F.col("component").like("mod_%") | (F.col("eventname") == COURSE_VIEWED)
    forum = (F.col("component") == "mod_forum") & (F.col("action") == "viewed")
    return (
        _flag(active, ACTIVE)
        + _flag(forum, FORUM_VIEW)
        + _flag(F.col("eventname").isin(list(LEARNING_OBJECT_VIEWS)), LEARNING_OBJECT_VIEW)
    )


def log_between(t: LearningTables, course_ids: Sequence[int] | None, start: int, end: int) -> DataFrame:
    """Log rows of the chosen courses in the closed reporting window; both filters reach the scan."""
    return in_courses(between_times(t.logstore_standard_log, start, end), "courseid", course_ids)


def clip_to_course(log: DataFrame, windows: DataFrame) -> DataFrame:
    """Rows inside their course's closed window. `windows` has one row per course."""
    return log.join(windows, log["courseid"] == windows["course_id"]).filter(
        F.col("timecreated").between(F.col("course_start"), F.col("course_end"))
    )


def windowed_log(
    t: LearningTables,
    start: int,
    end: int,
    course_ids: Sequence[int] | None = None,
    open_end_at: int | None = None,
) -> DataFrame:
    """Log rows of enrolled students, clipped to the course window and the reporting window."""
    log = log_between(t, course_ids, start, end)
    roster = course_roster(t, course_ids, open_end_at=open_end_at)
    return log.join(
        roster,
        (log["userid"] == roster["student_id"])
        & (log["courseid"] == roster["course_id"])
        & F.col("timecreated").between(F.col("course_start"), F.col("course_end")),
    ).select(
        F.col("id").alias("event_id"), "student_id", "course_id", "eventname", "component", "action",
        "objectid", "contextinstanceid", "timecreated",
    )


def teacher_log(t: LearningTables, as_of: int, teachers: DataFrame, course_ids: Sequence[int] | None = None) -> DataFrame:
    """The log events of `teachers` (see `teacher_roster`) in `[course_start, course_end)`: event_id, event_time and the teacher's columns.

    One scan, of the time that the courses span; a bitmap of the (teacher, course) pairs lets nearly only their rows through it, so students' rows
    meet no shuffle also where teachers are too many to broadcast.
    """
    windows = course_windows(t, course_ids, open_end_at=as_of)
    span = (windows.agg(F.min("course_start")).scalar(), windows.agg(F.max("course_end") - 1).scalar())
    log = in_courses(between_times(t.logstore_standard_log, *span), "courseid", course_ids)
    log = log.filter(may_hold(key_bitmap(teachers, ("teacher_id", "course_id")), ("userid", "courseid"))).select(
        F.col("id").alias("event_id"), "userid", "courseid", F.col("timecreated").alias("event_time")
    )
    return log.join(
        teachers,
        (log["userid"] == teachers["teacher_id"])
        & (log["courseid"] == teachers["course_id"])
        & (F.col("event_time") >= F.col("course_start"))
        & (F.col("event_time") < F.col("course_end")),
    ).select("teacher_id", "course_id", "course_start", "course_end", "event_id", "event_time")


def teacher_events(t: LearningTables, as_of: int, course_ids: Sequence[int] | None = None) -> DataFrame:
    """Teachers with each of their events in `[course_start, course_end)`; a teacher with none keeps one null row.

    Inner join plus the teachers left over: a left join would put the large log on the side Spark can neither
    broadcast nor split when one teacher's key is hot. What is found (teachers' events only) is staged, so that both parts read it
    and the log is scanned once.
    """
    teachers = teacher_roster(t, as_of, course_ids)
    found = stage(teacher_log(t, as_of, teachers, course_ids))
    silent = teachers.join(found.select("teacher_id", "course_id").distinct(), ["teacher_id", "course_id"], "left_anti")
    nothing = F.lit(None).cast("long")
    return found.unionByName(
        silent.select(
            "teacher_id", "course_id", "course_start", "course_end",
            nothing.alias("event_id"), nothing.alias("event_time"),
        )
    )


def _day() -> Column:
    return F.expr(f"timecreated div {DAY}")


def activity_seconds(
    t: LearningTables,
    start: int,
    end: int,
    course_ids: Sequence[int] | None = None,
    open_end_at: int | None = None,
) -> DataFrame:
    """One row per (student_id, course_id, second) holding an event, with the kind of its last event by id.

    Every user of the log is kept here; the roster is joined to the totals, so the log is never shuffled for it.
    """
    return reduced_seconds(clip_to_course(log_between(t, course_ids, start, end), course_windows(t, course_ids, open_end_at)))


def reduced_seconds(events: DataFrame) -> DataFrame:
    """Clipped events as one row per (student_id, course_id, second), with the kind of the second's last event by id."""
    seconds = (
        events.select("userid", "course_id", "timecreated", "id", event_kind().alias("kind"))
        .groupBy(F.col("userid").alias("student_id"), "course_id", "timecreated")
        .agg(
            F.max_by("kind", "id").alias("last_kind"),
            F.max(F.col("kind").bitwiseAND(FORUM_VIEW)).alias("forum_bit"),
        )
    )
    # Both aggregates feed one column, so the plan up to here is the same for every indicator and its shuffle is
    # reused when several run in one job.
    kind = F.col("last_kind") + F.when(F.col("forum_bit") > 0, ANY_FORUM_VIEW).otherwise(0)
    return seconds.select("student_id", "course_id", "timecreated", _day().alias("day"), kind.alias("kind"))


def capped_totals(seconds: DataFrame, bit: int, gap: Gap, cap: int) -> DataFrame:
    """Per (student_id, course_id): `total`, the capped gaps after events with `bit`, and `saw_forum`.

    Rows of the same second are told apart by `last_id`, where there is one; see `facts.moments`.
    """
    order = [c for c in ("timecreated", "last_id") if c in seconds.columns]
    in_day = W.partitionBy("student_id", "course_id", "day").orderBy(*order)
    counted = F.col("kind").bitwiseAND(bit) > 0
    days = (
        seconds.withColumn("next_time", F.lead("timecreated").over(in_day))
        .groupBy("student_id", "course_id", "day")
        .agg(
            F.sum(
                F.when(counted & F.col("next_time").isNotNull(), gap(F.col("timecreated"), F.col("next_time"), cap))
            ).alias("inside"),
            F.min("timecreated").alias("first_time"),
            F.max("timecreated").alias("last_time"),
            F.max_by("kind", F.struct(*order) if len(order) > 1 else "timecreated").alias("kind"),
            F.max(F.col("kind").bitwiseAND(ANY_FORUM_VIEW)).alias("forum_bit"),
        )
    )
    over_days = W.partitionBy("student_id", "course_id").orderBy("day")
    return (
        days.withColumn("next_day_time", F.lead("first_time").over(over_days))
        .groupBy("student_id", "course_id")
        .agg(
            F.sum(
                F.coalesce(F.col("inside"), F.lit(0))
                + F.coalesce(F.when(counted, gap(F.col("last_time"), F.col("next_day_time"), cap)), F.lit(0))
            ).alias("total"),
            (F.max("forum_bit") > 0).alias("saw_forum"),
        )
    )


def next_event_time(events: DataFrame) -> DataFrame:
    """Add `next_event_time` to `windowed_log` rows: the student's next event in the course by (time, id).

    The exact per-event form of the gap, built the same way: distinct seconds, days, then a join back on the second.
    """
    pair = ["student_id", "course_id"]
    seconds = (
        events.groupBy(*pair, "timecreated").agg(F.max("event_id").alias("last_id")).withColumn("day", _day())
    )
    in_day = W.partitionBy(*pair, "day").orderBy("timecreated")
    seconds = seconds.withColumn("later", F.lead("timecreated").over(in_day))
    days = seconds.groupBy(*pair, "day").agg(F.min("timecreated").alias("first_time"))
    days = days.withColumn("next_day_time", F.lead("first_time").over(W.partitionBy(*pair).orderBy("day")))
    following = seconds.join(days, [*pair, "day"]).select(
        *pair, "timecreated", "last_id", F.coalesce("later", "next_day_time").alias("next_second")
    )
    return (
        events.join(following, [*pair, "timecreated"])
        .withColumn(
            "next_event_time",
            F.when(F.col("event_id") < F.col("last_id"), F.col("timecreated")).otherwise(F.col("next_second")),
        )
        .select(*events.columns, "next_event_time")
    )
