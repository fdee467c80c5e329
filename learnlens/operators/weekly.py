"""Weekly activity of teachers, in seven-day slots that start at the course start."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from learnlens.functions.periods import WEEK
from learnlens.operators.activity import teacher_log
from learnlens.operators.roster import teacher_roster
from learnlens.operators.states import state_of
from learnlens.sources.tables import LearningTables

_SLOTS = f"greatest(1, (greatest(0, course_end - course_start) + {WEEK - 1}) div {WEEK})"


def _active_weeks(t: LearningTables, as_of: int, teachers: DataFrame, course_ids: Sequence[int] | None) -> DataFrame:
    """Non-empty slots of teachers only: teacher_id, course_id, week, interactions.

    Students' events go at the scan; partial counts shrink a hot teacher on the map side.
    """
    return (
        teacher_log(t, as_of, teachers, course_ids)
        .groupBy("teacher_id", "course_id", F.expr(f"(event_time - course_start) div {WEEK}").alias("week"))
        .agg(F.count(F.lit(1)).alias("interactions"))
    )


def weekly_interactions(t: LearningTables, as_of: int, course_ids: Sequence[int] | None = None) -> DataFrame:
    """Every slot of every teacher's course, empty ones with 0."""
    teachers = teacher_roster(t, as_of, course_ids)
    slots = teachers.select(
        "teacher_id", "course_id", F.explode(F.expr(f"sequence(0L, {_SLOTS} - 1)")).alias("week")
    )
    counts = _active_weeks(t, as_of, teachers, course_ids)
    return slots.join(counts, ["teacher_id", "course_id", "week"], "left").select(
        "teacher_id", "course_id", "week", F.coalesce("interactions", F.lit(0).cast("long")).alias("interactions")
    )


def teacher_consistency(
    t: LearningTables, as_of: int, course_ids: Sequence[int] | None = None, threshold: float = 5.0
) -> DataFrame:
    """teacher_id, course_id, state: does every slot hold at least `threshold` events?

    Slots that reach the threshold are counted and compared with the slot number, so empty slots need no rows.
    """
    teachers = teacher_roster(t, as_of, course_ids)
    full = (
        _active_weeks(t, as_of, teachers, course_ids)
        .filter(F.col("interactions") >= F.lit(float(threshold)))
        .groupBy("teacher_id", "course_id")
        .agg(F.count(F.lit(1)).alias("full_weeks"))
    )
    every_week = F.coalesce(F.col("full_weeks"), F.lit(0)) == F.expr(_SLOTS)
    return teachers.join(full, ["teacher_id", "course_id"], "left").select(
        "teacher_id", "course_id", state_of(every_week | F.lit(threshold <= 0)).alias("state")
    )


def course_consistency(
    t: LearningTables, as_of: int, course_ids: Sequence[int] | None = None, threshold: float = 5.0
) -> DataFrame:
    """course_id, state: a course takes the state of its teacher with the highest id."""
    return (
        teacher_consistency(t, as_of, course_ids, threshold)
        .groupBy("course_id")
        .agg(F.max_by("state", "teacher_id").alias("state"))
    )
