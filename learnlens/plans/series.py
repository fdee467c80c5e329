"""Chart-ready series: ordered labels with one value each."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from learnlens.functions.literals import literal_rows
from learnlens.functions.periods import HOUR
from learnlens.operators.numbering import BY_STUDENT, number_rows
from learnlens.operators.states import STATES
from learnlens.plans import teacher
from learnlens.plans.student import STUDENT_INDICATORS, StudentParams, roster_rows, student_rows, wide_totals
from learnlens.sources.tables import LearningTables


def state_counts(spark: SparkSession, states: DataFrame) -> DataFrame:
    """position, label, value: always the three states in chart order, zeros kept."""
    slices = literal_rows(spark, list(enumerate(STATES, start=1)), "position long, label string")
    counts = states.groupBy(F.col("state").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return slices.join(counts, "label", "left").select(
        "position", "label", F.coalesce("n", F.lit(0).cast("long")).alias("value")
    )


def bar_series(t: LearningTables, indicator_id: str, params: StudentParams) -> DataFrame:
    """position, label, value: one bar per indicator row in its sort order, seconds as hours rounded up."""
    spec = STUDENT_INDICATORS[indicator_id]
    rows = student_rows(t, indicator_id, params, spec.sort_order, number="position")
    return rows.select("position", F.col("student_id").cast("string").alias("label"), _bar(indicator_id).alias("value"))


def bar_table(t: LearningTables, params: Mapping[str, StudentParams]) -> DataFrame:
    """indicator_id, position, label, value: the rows of `bar_series` of several indicators, whose parameters agree.

    Indicators with a row for every student of every course become one wide frame: the roster with its number in each order, joined once to each
    source of totals, and then a row per indicator.
    """
    of_roster = {i: p for i, p in params.items() if STUDENT_INDICATORS[i].fill_roster and STUDENT_INDICATORS[i].sort_order != BY_STUDENT}
    frames = [bar_series(t, i, p).withColumn("indicator_id", F.lit(i)) for i, p in params.items() if i not in of_roster]
    if of_roster:
        places = {order: f"position_{k}" for k, order in enumerate(dict.fromkeys(STUDENT_INDICATORS[i].sort_order for i in of_roster))}
        rows = roster_rows(t, ["student_id", "course_id"], next(iter(of_roster.values())).course_ids)
        for order, place in places.items():
            rows = number_rows(rows, order, place)
        for totals in wide_totals(t, of_roster):
            rows = rows.join(totals, ["student_id", "course_id"], "left")
        bars = [
            F.struct(F.lit(i).alias("indicator_id"), F.col(places[STUDENT_INDICATORS[i].sort_order]).alias("position"), _bar(i).alias("value"))
            for i in of_roster
        ]
        frames.append(rows.select(F.col("student_id").cast("string").alias("label"), F.inline(F.array(*bars))))
    return reduce(DataFrame.unionByName, frames)


def _bar(indicator_id: str) -> Column:
    """An indicator's value, 0 where there is none; seconds as hours rounded up."""
    spec = STUDENT_INDICATORS[indicator_id]
    value = F.coalesce(spec.value, F.lit(0).cast("long"))
    return (F.expr(f"(coalesce({spec.value}, 0) + {HOUR - 1}) div {HOUR}") if spec.in_hours else value).cast("long")


def teacher_states(
    t: LearningTables,
    indicator_id: str,
    as_of: int,
    course_ids: Sequence[int] | None = None,
    **arguments: Any,
) -> DataFrame:
    """student_id, course_id, state of a teacher indicator by its registry id."""
    if indicator_id == "consistent-use-lms":
        return teacher.consistent_use_lms(t, as_of, course_ids, **arguments)
    functions = {
        "course_performance_feedback": teacher.course_performance_feedback,
        "personalized_feedback": teacher.personalized_feedback,
        "timely_feedback": teacher.timely_feedback,
        "monitoring_forums": teacher.monitoring_forums,
    }
    return functions[indicator_id](t, course_ids, **arguments)


def chart_series(
    spark: SparkSession,
    t: LearningTables,
    indicator_id: str,
    as_of: int,
    course_ids: Sequence[int] | None = None,
    **arguments: Any,
) -> DataFrame:
    """The series of any indicator: bars for students, a pie for teachers."""
    if indicator_id in STUDENT_INDICATORS:
        return bar_series(t, indicator_id, StudentParams(as_of, course_ids, **arguments))
    return state_counts(spark, teacher_states(t, indicator_id, as_of, course_ids, **arguments))
