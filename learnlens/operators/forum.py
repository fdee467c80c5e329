"""Forum posts of course members and reply chains that end in a resolution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from learnlens.functions.staging import stage
from learnlens.functions.text import RESOLUTION_KEYWORDS, contains_any
from learnlens.operators.membership import key_bitmap, may_hold
from learnlens.operators.roster import course_participants, in_courses
from learnlens.sources.tables import LearningTables


def member_posts(
    t: LearningTables, course_ids: Sequence[int] | None = None, open_end_at: int | None = None, *more: Column
) -> DataFrame:
    """Posts of course members in `[course_start, course_end)`, with role flags; `more` columns are computed at the scan of the posts."""
    posts = t.forum_posts.select(
        F.col("id").alias("post_id"), "discussion", F.col("parent").alias("parent_post_id"),
        F.col("userid").alias("author_id"), "created", *more,
    )
    discussions = in_courses(t.forum_discussions, "course", course_ids).select(
        F.col("id").alias("discussion"), F.col("course").alias("course_id")
    )
    return (
        posts.join(discussions, "discussion")
        .join(course_participants(t, course_ids, open_end_at), ["author_id", "course_id"])
        .filter((F.col("created") >= F.col("course_start")) & (F.col("created") < F.col("course_end")))
        .drop("discussion", "created", "course_start", "course_end")
    )


def participant_posts(
    t: LearningTables,
    course_ids: Sequence[int] | None = None,
    keywords: Sequence[str] = RESOLUTION_KEYWORDS,
    open_end_at: int | None = None,
) -> DataFrame:
    """`member_posts` with the keyword test of every post. The message is tested at the scan and dropped, so no text is shuffled."""
    posts = member_posts(t, course_ids, open_end_at, contains_any(F.col("message"), keywords).alias("resolves"))
    return posts.select("post_id", "course_id", "parent_post_id", "author_id", "author_is_student", "author_is_teacher", "resolves")


def resolved_chains(
    t: LearningTables,
    course_ids: Sequence[int] | None = None,
    keywords: Sequence[str] = RESOLUTION_KEYWORDS,
    open_end_at: int | None = None,
) -> DataFrame:
    """Distinct student_id, course_id with a chain: student post, teacher reply to it, the same student's
    follow-up to that reply with a resolution keyword.

    Chains are found by their keys, without any text; the other side of each join has one row per post, so no join multiplies rows. Only then the
    messages of their follow-ups are searched, where they are read: a bitmap of the follow-ups keeps the search off all other posts. The keys of the
    chains are staged, as the bitmap and the last join both read them.
    """
    posts = member_posts(t, course_ids, open_end_at)
    is_student = F.col("author_is_student") == 1
    follow_ups = posts.filter(is_student).select(
        "course_id", F.col("parent_post_id").alias("reply_id"), F.col("author_id").alias("student_id"), F.col("post_id").alias("follow_up_id")
    )
    replies = posts.filter(F.col("author_is_teacher") == 1).select(
        "course_id", F.col("post_id").alias("reply_id"), F.col("parent_post_id").alias("question_id")
    )
    questions = posts.filter(is_student).select(
        "course_id", F.col("post_id").alias("question_id"), F.col("author_id").alias("student_id")
    )
    chains = stage(
        follow_ups.join(replies, ["course_id", "reply_id"])
        .join(questions, ["course_id", "question_id", "student_id"], "left_semi")
        .select("student_id", "course_id", "follow_up_id")
    )
    wanted = may_hold(key_bitmap(chains, ("follow_up_id",)), ("id",))
    resolving = t.forum_posts.filter(F.when(wanted, contains_any(F.col("message"), keywords)).otherwise(False))
    return chains.join(resolving.select(F.col("id").alias("follow_up_id")), "follow_up_id", "left_semi").select("student_id", "course_id").distinct()
