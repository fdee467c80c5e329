"""Who belongs to which course: rosters, participants, course windows and the course picker."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from learnlens.sources.tables import LearningTables

COURSE_CONTEXT = 50
STUDENT_ROLES = ("student",)
TEACHER_ROLES = ("editingteacher", "teacher")


def course_ids_of(values: Iterable[int]) -> list[int]:
    """Chosen course ids as unique ints; an empty choice or a 0 is an error."""
    ids = list(dict.fromkeys(int(value) for value in values))
    if not ids or 0 in ids:
        raise ValueError("invalid course ids")
    return ids


def in_courses(df: DataFrame, column: str, course_ids: Sequence[int] | None) -> DataFrame:
    """Keep rows of the chosen courses (None: all). The literal list reaches the scan as a pushed filter."""
    return df if course_ids is None else df.filter(F.col(column).isin(list(course_ids)))


def course_windows(
    t: LearningTables, course_ids: Sequence[int] | None = None, open_end_at: int | None = None
) -> DataFrame:
    """course_id, course_start, course_end. End 0 stays 0 unless `open_end_at` replaces it."""
    end: Column = F.col("enddate")
    if open_end_at is not None:
        end = F.when(end == 0, F.lit(open_end_at).cast("long")).otherwise(end)
    return in_courses(t.course, "id", course_ids).select(
        F.col("id").alias("course_id"), F.col("startdate").alias("course_start"), end.alias("course_end")
    )


def _role_holders(
    t: LearningTables, roles: Sequence[str], course_ids: Sequence[int] | None, open_end_at: int | None
) -> DataFrame:
    """One row per role assignment in a chosen course. Course, context and role sides are small and are broadcast
    by Spark only while their measured size allows it; otherwise they are shuffle joins."""
    contexts = in_courses(t.context.filter(F.col("contextlevel") == COURSE_CONTEXT), "instanceid", course_ids).select(
        F.col("id").alias("contextid"), F.col("instanceid").alias("course_id")
    )
    held = t.role.filter(F.col("shortname").isin(list(roles))).select(F.col("id").alias("roleid"), "shortname")
    places = contexts.join(course_windows(t, course_ids, open_end_at), "course_id")
    return (
        t.role_assignments.select("userid", "contextid", "roleid").join(held, "roleid").join(places, "contextid")
    )


def course_roster(
    t: LearningTables,
    course_ids: Sequence[int] | None = None,
    roles: Sequence[str] = STUDENT_ROLES,
    open_end_at: int | None = None,
) -> DataFrame:
    """Distinct student_id, course_id, course_start, course_end of the users holding one of `roles`."""
    return (
        _role_holders(t, roles, course_ids, open_end_at)
        .select(F.col("userid").alias("student_id"), "course_id", "course_start", "course_end")
        .distinct()
    )


def teacher_roster(t: LearningTables, as_of: int, course_ids: Sequence[int] | None = None) -> DataFrame:
    """Distinct teacher_id, course_id and course window, an open course ending at `as_of`."""
    return course_roster(t, course_ids, TEACHER_ROLES, as_of).withColumnRenamed("student_id", "teacher_id")


def course_participants(
    t: LearningTables, course_ids: Sequence[int] | None = None, open_end_at: int | None = None
) -> DataFrame:
    """One row per (author_id, course_id) with 0/1 flags for the student and the teacher role; both may be 1."""

    def holds(roles: Sequence[str]) -> Column:
        return F.max(F.when(F.col("shortname").isin(list(roles)), 1).otherwise(0))

    return (
        _role_holders(t, STUDENT_ROLES + TEACHER_ROLES, course_ids, open_end_at)
        .groupBy(F.col("userid").alias("author_id"), "course_id", "course_start", "course_end")
        .agg(holds(STUDENT_ROLES).alias("author_is_student"), holds(TEACHER_ROLES).alias("author_is_teacher"))
    )


def user_courses(
    t: LearningTables, selected_ids: Sequence[int] = (), user_ids: Sequence[int] | None = None
) -> DataFrame:
    """Course picker rows: user_id, course_id, course_name, selected, for every course a user has a role in."""
    assigned = t.role_assignments
    if user_ids is not None:
        assigned = assigned.filter(F.col("userid").isin(list(user_ids)))
    contexts = t.context.filter(F.col("contextlevel") == COURSE_CONTEXT).select(
        F.col("id").alias("contextid"), F.col("instanceid").alias("course_id")
    )
    memberships = (
        assigned.join(contexts, "contextid").select(F.col("userid").alias("user_id"), "course_id").distinct()
    )
    names = t.course.select(F.col("id").alias("course_id"), F.col("shortname").alias("course_name"))
    return memberships.join(names, "course_id").select(
        "user_id", "course_id", "course_name", F.col("course_id").isin([int(i) for i in selected_ids]).alias("selected")
    )
