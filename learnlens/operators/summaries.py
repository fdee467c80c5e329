"""Day summaries of activity, kept by the caller, from which a chart is refreshed without reading the log again.

A refresh asks for another period ending now, and nearly all of its days have been read before. A summary row holds what any period needs of one
(student, course, day): capped seconds inside the day for each kind of event, and its first and last second with the last kind, so that
neighbouring days merge by the gap between them, over midnight or over empty days. Days never change once they are over, so the caller
stores them (by day, as Parquet) and adds new days only. A period that begins or ends inside a day takes the events of those days from
the log: at most two days are scanned, whatever the period.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from learnlens.functions.gaps import least_gap
from learnlens.functions.periods import DAY
from learnlens.operators.activity import ACTIVE, ANY_FORUM_VIEW, FORUM_VIEW, LEARNING_OBJECT_VIEW, clip_to_course, log_between, reduced_seconds
from learnlens.operators.roster import course_windows, in_courses
from learnlens.sources.tables import LearningTables, time_bounds

#: The column of `merged_totals` for each kind of event.
TOTALS = {ACTIVE: "active", FORUM_VIEW: "forum", LEARNING_OBJECT_VIEW: "object"}
_INSIDE = {ACTIVE: "active_inside", FORUM_VIEW: "forum_inside", LEARNING_OBJECT_VIEW: "object_inside"}


def days_of(seconds: DataFrame, cap: int) -> DataFrame:
    """Summary rows of distinct seconds (see `activity.activity_seconds`), for a session cap.

    Rows of the same second are told apart by `last_id`, where there is one; see `facts.moments`.
    """
    order = [c for c in ("timecreated", "last_id") if c in seconds.columns]
    in_day = W.partitionBy("student_id", "course_id", "day").orderBy(*order)
    gap = F.when(F.col("next_time").isNotNull(), least_gap(F.col("timecreated"), F.col("next_time"), cap)).otherwise(0)
    has = lambda bit: F.col("kind").bitwiseAND(bit) > 0
    return (
        seconds.withColumn("next_time", F.lead("timecreated").over(in_day))
        .groupBy("student_id", "course_id", "day")
        .agg(
            *[F.sum(F.when(has(bit), gap).otherwise(0)).cast("long").alias(name) for bit, name in _INSIDE.items()],
            F.min("timecreated").alias("first_time"),
            F.max("timecreated").alias("last_time"),
            F.max_by("kind", F.struct(*order)).alias("last_kind"),
            F.max(F.col("kind").bitwiseAND(ANY_FORUM_VIEW)).alias("forum_bit"),
        )
    )


def day_summaries(
    t: LearningTables, from_day: int, until_day: int, cap: int, course_ids: Sequence[int] | None = None, open_end_at: int | None = None
) -> DataFrame:
    """Summary rows of the days `from_day` to `until_day` - 1 (days since the epoch), of all users in the chosen courses' windows.

    The scan keeps those days. To extend stored summaries, ask for the days after the last one stored.
    """
    log = log_between(t, course_ids, from_day * DAY, until_day * DAY - 1)
    return days_of(reduced_seconds(clip_to_course(log, course_windows(t, course_ids, open_end_at))), cap)


def whole_days(start: int, end: int) -> tuple[int, int]:
    """The days, from and until, that lie as a whole in the closed period and are over: the day of its end never is."""
    first = -(-start // DAY)
    return first, max(first, end // DAY)


def period_days(
    t: LearningTables, stored: DataFrame, start: int, end: int, cap: int, course_ids: Sequence[int] | None = None, open_end_at: int | None = None
) -> DataFrame:
    """Summary rows of the closed period: whole days as stored, the rest of it (less than a day at either end) from the log."""
    first, until = whole_days(start, end)
    inside = in_courses(stored.filter((F.col("day") >= first) & (F.col("day") < until)), "course_id", course_ids)
    time, whole = F.col("timecreated"), t.logstore_standard_log
    ends = ((start, min(first * DAY - 1, end)), (max(until * DAY, start), end))
    edges = reduce(Column.__or__, (time_bounds(whole, a, b) & time.between(a, b) for a, b in ends))
    log = in_courses(whole.filter(edges), "courseid", course_ids)
    rest = days_of(reduced_seconds(clip_to_course(log, course_windows(t, course_ids, open_end_at))), cap)
    return inside.select(*rest.columns).unionByName(rest)


def merged_totals(days: DataFrame, cap: int) -> DataFrame:
    """Per (student_id, course_id): the capped gaps after events of each kind, `active`, `forum` and `object`, and `saw_forum`.

    Each is the `total` of `activity.capped_totals` for that kind.
    """
    over_days = W.partitionBy("student_id", "course_id").orderBy("day")
    across = F.when(F.col("next_time").isNotNull(), least_gap(F.col("last_time"), F.col("next_time"), cap)).otherwise(0)
    has = lambda bit: F.col("last_kind").bitwiseAND(bit) > 0
    return (
        days.withColumn("next_time", F.lead("first_time").over(over_days))
        .groupBy("student_id", "course_id")
        .agg(
            *[F.sum(F.col(name) + F.when(has(bit), across).otherwise(0)).cast("long").alias(TOTALS[bit]) for bit, name in _INSIDE.items()],
            (F.max("forum_bit") > 0).alias("saw_forum"),
        )
    )
