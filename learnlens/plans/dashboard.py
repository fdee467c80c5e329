"""The dashboard as one table, and the refresh of a single chart."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from learnlens.functions.literals import literal_rows
from learnlens.functions.staging import stage
from learnlens.operators import assessment, forum
from learnlens.operators.roster import course_ids_of, course_roster, teacher_roster
from learnlens.plans.registry import INDICATORS, params_for_filter
from learnlens.plans.series import bar_table, chart_series, state_counts, teacher_states
from learnlens.plans.student import StudentParams
from learnlens.sources.tables import LearningTables

BLOCK_COLUMNS = (
    "display_order int, indicator_id string, indicator_name string, behaviour_group string, "
    "student_success boolean, control string"
)


def _union(frames: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


#: Indicators that judge graded submissions.
GRADED = {"course_performance_feedback", "personalized_feedback", "timely_feedback"}


def _pie_sources(t: LearningTables, as_of: int, course_ids: Sequence[int] | None, graded: DataFrame) -> DataFrame:
    """indicator_id of every pie that has source rows. A pie always has three slices, so its rows cannot tell.

    Feedback and timeliness read the roster; the others read submissions, posts and teachers.
    """
    enrolled = course_roster(t, course_ids).select("course_id")
    sources = {
        "course_performance_feedback": graded.select("course_id"),
        "personalized_feedback": enrolled,
        "timely_feedback": enrolled,
        "monitoring_forums": forum.member_posts(t, course_ids).select("course_id"),
        "consistent-use-lms": teacher_roster(t, as_of, course_ids).select("course_id"),
    }
    return _union(
        # one row tells; a limit lets the scan stop early
        rows.select(F.lit(indicator_id).alias("indicator_id")).limit(1) for indicator_id, rows in sources.items()
    )


def dashboard(
    spark: SparkSession,
    t: LearningTables,
    as_of: int,
    course_ids: Sequence[int] | None = None,
    configured: Mapping[str, Any] | None = None,
    group: str | None = None,
) -> DataFrame:
    """All series with the metadata of their indicator; an indicator without data keeps one row, has_data false.

    No course chosen (an empty list) gives no rows at all.
    """
    chosen = [d for d in INDICATORS.values() if group is None or d.group == group]
    blocks = [
        (i, d.id, d.name, d.group, d.student_success, d.control["name"] if d.control else None)
        for i, d in enumerate(chosen, start=1)
    ]
    if course_ids is not None and not list(course_ids):
        return literal_rows(spark, [], BLOCK_COLUMNS + ", has_data boolean, position long, label string, value long")
    bars = {d.id: StudentParams(as_of, course_ids, shared=True, **d.defaults(configured)) for d in chosen if d.axis is not None}
    columns = ("indicator_id", "position", "label", "value")
    frames = [bar_table(t, bars).select(*columns)] if bars else []
    pies = [d.id for d in chosen if d.axis is None]
    # Submissions and grades are read and joined once for all that judge them.
    graded = stage(assessment.graded_submissions(t, course_ids)) if pies else None
    for d in chosen:
        if d.axis is None:
            more = {"graded": graded} if d.id in GRADED else {}
            states = state_counts(spark, teacher_states(t, d.id, as_of, course_ids, **d.defaults(configured), **more))
            frames.append(states.select(F.lit(d.id).alias("indicator_id"), *columns[1:]))
    series = _union(frames)
    if pies:
        present = _pie_sources(t, as_of, course_ids, graded).select("indicator_id", F.lit(True).alias("has_source"))
        series = series.join(present, "indicator_id", "left").filter(
            F.col("has_source") | ~F.col("indicator_id").isin(pies)
        )
    return (
        literal_rows(spark, blocks, BLOCK_COLUMNS)
        .join(series, "indicator_id", "left")
        .select(
            "display_order", "indicator_id", "indicator_name", "behaviour_group", "student_success", "control",
            F.col("position").isNotNull().alias("has_data"),
            "position", "label", "value",
        )
    )


def refresh(
    spark: SparkSession,
    t: LearningTables,
    indicator_id: str,
    course_ids: Iterable[int],
    filter_value: str,
    as_of: int,
    configured: Mapping[str, Any] | None = None,
    summaries: DataFrame | None = None,
) -> DataFrame:
    """One chart again with another filter value. Unknown values and invalid course ids are errors.

    With `summaries`, stored day summaries of the configured session cap, capped times are merged from them and the log is read for the
    days at the period's ends only.
    """
    arguments = params_for_filter(indicator_id, filter_value, configured)
    if summaries is not None:
        arguments["summaries"] = summaries
    return chart_series(spark, t, indicator_id, as_of, course_ids_of(course_ids), **arguments)
