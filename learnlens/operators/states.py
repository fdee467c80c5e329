"""Behaviour states: folding evidence per student and course, and filling the roster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The three labels, in chart order.
EXHIBITED = "Exhibited"
NOT_EXHIBITED = "Not Exhibited"
NOT_REQUIRED = "Not Required"
STATES = (EXHIBITED, NOT_EXHIBITED, NOT_REQUIRED)


def state_of(good: Column) -> Column:
    return F.when(good, EXHIBITED).otherwise(NOT_EXHIBITED)


def fold_any_good(evidence: DataFrame, good: str) -> DataFrame:
    """student_id, course_id, state: one good row is enough. Order-free, so partial aggregation applies."""
    return evidence.groupBy("student_id", "course_id").agg(state_of(F.max(good)).alias("state"))


def fold_all_good(evidence: DataFrame, good: str) -> DataFrame:
    """student_id, course_id, state: one bad row is enough for Not Exhibited."""
    return evidence.groupBy("student_id", "course_id").agg(state_of(F.min(good)).alias("state"))


def fill_states(roster: DataFrame, states: DataFrame, missing: str = NOT_REQUIRED) -> DataFrame:
    """Every (student_id, course_id) of the roster with its state, `missing` where there was no evidence."""
    return (
        roster.select("student_id", "course_id")
        .join(states, ["student_id", "course_id"], "left")
        .select("student_id", "course_id", F.coalesce("state", F.lit(missing)).alias("state"))
    )
