"""The five teacher indicators: one state per (student_id, course_id).

The three that judge grades take `graded`, the rows of `assessment.graded_submissions`, from a job that holds several of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from learnlens.functions.text import IMPROVEMENT_KEYWORDS, RESOLUTION_KEYWORDS
from learnlens.operators import assessment, forum, uniqueness, weekly
from learnlens.operators.roster import course_roster
from learnlens.operators.states import NOT_EXHIBITED, fill_states, fold_all_good, fold_any_good
from learnlens.plans.settings import SETTINGS
from learnlens.sources.tables import LearningTables


def course_performance_feedback(
    t: LearningTables,
    course_ids: Sequence[int] | None = None,
    gradethreshold: float = SETTINGS["gradethreshold"].default,
    keywords: Sequence[str] = IMPROVEMENT_KEYWORDS,
    open_end_at: int | None = None,
    graded: DataFrame | None = None,
) -> DataFrame:
    """Do students with a low grade get feedback with improvement language? One such comment is enough."""
    low = assessment.low_grade_feedback(t, course_ids, gradethreshold, keywords, open_end_at, graded)
    return fill_states(course_roster(t, course_ids), fold_any_good(low, "addressed"))


def personalized_feedback(
    t: LearningTables,
    course_ids: Sequence[int] | None = None,
    feedbackgoal: float = SETTINGS["feedbackgoal"].default,
    open_end_at: int | None = None,
    graded: DataFrame | None = None,
) -> DataFrame:
    """Is all feedback to the student unique enough within its assignment?"""
    judged = uniqueness.unique_feedback(t, feedbackgoal, course_ids, open_end_at, graded)
    return fill_states(course_roster(t, course_ids), fold_all_good(judged, "unique_enough"))


def timely_feedback(
    t: LearningTables,
    course_ids: Sequence[int] | None = None,
    days: int = SETTINGS["timelyfeedbackdays"].default,
    open_end_at: int | None = None,
    graded: DataFrame | None = None,
) -> DataFrame:
    """Is every latest submission graded within `days`? A missing grade is late."""
    if graded is None:
        attempts = assessment.attempts_on_time(t, course_ids, days, open_end_at)
    else:
        attempts = graded.withColumn("on_time", assessment.on_time(F.col("submission_date"), F.col("graded_date"), days))
    return fill_states(course_roster(t, course_ids), fold_all_good(attempts, "on_time"))


def monitoring_forums(
    t: LearningTables,
    course_ids: Sequence[int] | None = None,
    keywords: Sequence[str] = RESOLUTION_KEYWORDS,
    open_end_at: int | None = None,
) -> DataFrame:
    """Did a student's forum question get a teacher reply that the student called resolved?"""
    posts = forum.member_posts(t, course_ids, open_end_at)
    posted = posts.filter(F.col("author_is_student") == 1).select(
        F.col("author_id").alias("student_id"), "course_id", F.lit(False).alias("resolved")
    )
    resolved = forum.resolved_chains(t, course_ids, keywords, open_end_at).withColumn("resolved", F.lit(True))
    return fill_states(course_roster(t, course_ids), fold_any_good(posted.unionByName(resolved), "resolved"))


def consistent_use_lms(
    t: LearningTables,
    as_of: int,
    course_ids: Sequence[int] | None = None,
    interactionthreshold: float = SETTINGS["interactionthreshold"].default,
) -> DataFrame:
    """Is the course's teacher active in every week? Each student inherits the state of the course."""
    states = weekly.course_consistency(t, as_of, course_ids, interactionthreshold)
    roster = course_roster(t, course_ids).select("student_id", "course_id")
    return roster.join(states, "course_id", "left").select(
        "student_id", "course_id", F.coalesce("state", F.lit(NOT_EXHIBITED)).alias("state")
    )
