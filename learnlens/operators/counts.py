"""Per student and course counts. Each is aggregated before any join, so hot keys shrink on the map side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from learnlens.operators.roster import in_courses
from learnlens.sources.tables import LearningTables

DISCUSSION_VIEWED = r"\mod_forum\event\discussion_viewed"
MODULE_VIEWS = tuple(
    rf"\mod_{module}\event\course_module_viewed"
    for module in ("forum", "assign", "resource", "url", "page", "lesson")
)


def learning_object_accesses(t: LearningTables, course_ids: Sequence[int] | None = None) -> DataFrame:
    """student_id, course_id, total: views of the six module types, all time."""
    log = in_courses(t.logstore_standard_log, "courseid", course_ids)
    return (
        log.filter(F.col("eventname").isin(list(MODULE_VIEWS)))
        .groupBy(F.col("userid").alias("student_id"), F.col("courseid").alias("course_id"))
        .agg(F.count("id").alias("total"))
    )


def discussions_viewed(t: LearningTables, course_ids: Sequence[int] | None = None) -> DataFrame:
    """student_id, course_id, total: exact number of distinct discussions viewed, all time."""
    log = in_courses(t.logstore_standard_log, "courseid", course_ids)
    return (
        log.filter(F.col("eventname") == DISCUSSION_VIEWED)
        .groupBy(F.col("userid").alias("student_id"), F.col("courseid").alias("course_id"))
        .agg(F.countDistinct("objectid").alias("total"))
    )


def forum_posts_written(t: LearningTables, course_ids: Sequence[int] | None = None) -> DataFrame:
    """student_id, course_id, total: posts per author, counted per discussion before the course is looked up."""
    per_discussion = t.forum_posts.groupBy("discussion", F.col("userid").alias("student_id")).agg(
        F.count("id").alias("posts")
    )
    discussions = in_courses(t.forum_discussions, "course", course_ids).select(
        F.col("id").alias("discussion"), F.col("course").alias("course_id")
    )
    return (
        per_discussion.join(discussions, "discussion")
        .groupBy("student_id", "course_id")
        .agg(F.sum("posts").alias("total"))
    )
