"""Assignments: time from first view to submission, latest submissions, their grades and feedback."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from learnlens.functions.periods import DAY
from learnlens.functions.text import contains_any
from learnlens.operators.activity import clip_to_course, log_between
from learnlens.operators.membership import key_bitmap, may_hold
from learnlens.operators.roster import course_roster, course_windows, in_courses
from learnlens.sources.tables import LearningTables

ASSIGNMENT_VIEWED = r"\mod_assign\event\course_module_viewed"
ASSIGNMENT_SUBMITTED = r"\mod_assign\event\assessable_submitted"
ATTEMPT = ("assignment_id", "student_id", "attempt_number")


def _module_marks(
    t: LearningTables, start: int, end: int, course_ids: Sequence[int] | None, open_end_at: int | None
) -> DataFrame:
    """Per (student_id, course_id, module_id) inside both windows: a row with the first view, and one per second with a submit event.

    `first_view_time` is null in the rows of submits; `submit_time` is -1 in that of the view, never null, so that no filter inferred from
    a join reaches the scan and all uses of this frame share one scan and one shuffle. Distinct seconds bound a hot module.
    """
    time, viewed = F.col("timecreated"), F.col("eventname") == ASSIGNMENT_VIEWED
    log = log_between(t, course_ids, start, end).filter(F.col("eventname").isin(ASSIGNMENT_VIEWED, ASSIGNMENT_SUBMITTED))
    return (
        clip_to_course(log, course_windows(t, course_ids, open_end_at))
        .groupBy(
            F.col("userid").alias("student_id"), "course_id", F.col("contextinstanceid").alias("module_id"),
            F.coalesce(F.when(~viewed, time), F.lit(-1).cast("long")).alias("submit_time"),
        )
        .agg(F.min(F.when(viewed, time)).alias("first_view_time"))
    )


def first_views(
    t: LearningTables, start: int, end: int, course_ids: Sequence[int] | None = None, open_end_at: int | None = None
) -> DataFrame:
    """First view of every assignment module inside both windows, per (student_id, course_id, module_id)."""
    marks = _module_marks(t, start, end, course_ids, open_end_at)
    return marks.filter(F.col("first_view_time").isNotNull()).drop("submit_time")


def first_submissions(
    t: LearningTables, start: int, end: int, course_ids: Sequence[int] | None = None, open_end_at: int | None = None
) -> DataFrame:
    """First views that were followed by a submit event, with the first one: adds `first_submit_time`.

    A submit at or after the view is also at or after `start` and the course start, so the log scan keeps both bounds.
    """
    module = ["student_id", "course_id", "module_id"]
    submits = _module_marks(t, start, end, course_ids, open_end_at).filter(F.col("first_view_time").isNull()).drop("first_view_time")
    return (
        submits.join(first_views(t, start, end, course_ids, open_end_at), module)
        .filter(F.col("submit_time") >= F.col("first_view_time"))
        .groupBy(*module, "first_view_time")
        .agg(F.min("submit_time").alias("first_submit_time"))
    )


def assignment_durations(
    t: LearningTables, start: int, end: int, course_ids: Sequence[int] | None = None, open_end_at: int | None = None
) -> DataFrame:
    """Every first view of an enrolled student with `assignment_time_seconds`, 0 where no submit followed."""
    module = ["student_id", "course_id", "module_id"]
    submitted = first_submissions(t, start, end, course_ids, open_end_at).drop("first_view_time")
    enrolled = course_roster(t, course_ids).select("student_id", "course_id")
    return (
        first_views(t, start, end, course_ids, open_end_at)
        .join(enrolled, ["student_id", "course_id"], "left_semi")
        .join(submitted, module, "left")
        .withColumn(
            "assignment_time_seconds",
            F.coalesce(F.col("first_submit_time") - F.col("first_view_time"), F.lit(0).cast("long")),
        )
        .drop("first_submit_time")
    )


def assignment_totals(
    t: LearningTables, start: int, end: int, course_ids: Sequence[int] | None = None, open_end_at: int | None = None
) -> DataFrame:
    """student_id, course_id, total seconds. Modules never submitted add 0 and need no row here."""
    return (
        first_submissions(t, start, end, course_ids, open_end_at)
        .groupBy("student_id", "course_id")
        .agg(F.sum(F.col("first_submit_time") - F.col("first_view_time")).alias("total"))
    )


def _assignments(t: LearningTables, course_ids: Sequence[int] | None, open_end_at: int | None) -> DataFrame:
    """assignment_id with its course and course window."""
    return (
        in_courses(t.assign, "course", course_ids)
        .select(F.col("id").alias("assignment_id"), F.col("course").alias("course_id"))
        .join(course_windows(t, course_ids, open_end_at), "course_id")
    )


def submissions_in_course(
    t: LearningTables, course_ids: Sequence[int] | None = None, open_end_at: int | None = None
) -> DataFrame:
    """Latest, really submitted attempts inside the course window, of enrolled and other users alike."""
    submitted = t.assign_submission.filter((F.col("latest") == 1) & (F.col("status") == "submitted")).select(
        F.col("id").alias("submission_id"),
        F.col("assignment").alias("assignment_id"),
        F.col("userid").alias("student_id"),
        F.col("attemptnumber").alias("attempt_number"),
        "timecreated",
        F.col("timemodified").alias("submission_date"),
    )
    return (
        submitted.join(_assignments(t, course_ids, open_end_at), "assignment_id")
        .filter(
            (F.col("timecreated") < F.col("course_end"))
            & (F.col("submission_date") >= F.col("course_start"))
            & (F.col("submission_date") < F.col("course_end"))
        )
        .select(
            "submission_id", "assignment_id", "student_id", "course_id", "course_start", "course_end",
            "attempt_number", "submission_date",
        )
    )


def latest_submissions(
    t: LearningTables, course_ids: Sequence[int] | None = None, open_end_at: int | None = None
) -> DataFrame:
    """`submissions_in_course` of enrolled students only."""
    enrolled = course_roster(t, course_ids).select("student_id", "course_id")
    clipped = submissions_in_course(t, course_ids, open_end_at)
    return clipped.join(enrolled, ["student_id", "course_id"], "left_semi").select(*clipped.columns)


def grades_in_course(
    t: LearningTables, course_ids: Sequence[int] | None = None, open_end_at: int | None = None
) -> DataFrame:
    """Grade rows given before their course's end."""
    grades = t.assign_grades.select(
        F.col("id").alias("grade_id"),
        F.col("assignment").alias("assignment_id"),
        F.col("userid").alias("student_id"),
        F.col("attemptnumber").alias("attempt_number"),
        "grade",
        F.col("timemodified").alias("graded_date"),
    )
    return (
        grades.join(_assignments(t, course_ids, open_end_at), "assignment_id")
        .filter(F.col("graded_date") < F.col("course_end"))
        .drop("course_id", "course_start", "course_end")
    )


def graded_submissions(
    t: LearningTables, course_ids: Sequence[int] | None = None, open_end_at: int | None = None
) -> DataFrame:
    """Latest submissions with the grade rows of that attempt; ungraded ones keep nulls."""
    return latest_submissions(t, course_ids, open_end_at).join(
        grades_in_course(t, course_ids, open_end_at), list(ATTEMPT), "left"
    )


def with_comments(graded: DataFrame, comments: DataFrame) -> DataFrame:
    """`graded` with the columns of `comments` (assignment_id, grade_id and more); rows without a comment keep nulls.

    A left join could not broadcast its left side and would shuffle every comment ever written. So the comments first meet the
    graded rows in an inner join, and only those found go on. A bitmap of the graded rows' grades drops most of the others where
    they are read, so that their texts meet no shuffle where the graded rows are too many to broadcast.
    """
    place = ["assignment_id", "grade_id"]
    wanted = graded.filter(F.col("grade_id").isNotNull()).select(*place).distinct()
    seen = comments.filter(may_hold(key_bitmap(wanted, place), place))
    return graded.join(seen.join(wanted, place), place, "left")


def feedback_records(
    t: LearningTables, course_ids: Sequence[int] | None = None, open_end_at: int | None = None
) -> DataFrame:
    """Graded submissions with their feedback comments; those without keep nulls."""
    comments = t.assignfeedback_comments.select(
        F.col("id").alias("feedback_id"),
        F.col("assignment").alias("assignment_id"),
        F.col("grade").alias("grade_id"),
        F.col("commenttext").alias("feedback_text"),
    )
    return with_comments(graded_submissions(t, course_ids, open_end_at), comments)


def on_time(submission_date, graded_date, days: int):
    """Neither date missing or 0, and graded no earlier than submitted and within `days`."""
    limit = F.lit(int(days) * DAY).cast("long")
    return F.coalesce(
        (submission_date != 0)
        & (graded_date != 0)
        & (submission_date <= graded_date)
        & (graded_date <= submission_date + limit),
        F.lit(False),
    )


def feedback_latency(
    t: LearningTables, course_ids: Sequence[int] | None = None, days: int = 8, open_end_at: int | None = None
) -> DataFrame:
    """Per submission and grade: seconds to feedback (null if ungraded) and whether it came in time."""
    submission_date, graded_date = F.col("submission_date"), F.col("graded_date")
    return graded_submissions(t, course_ids, open_end_at).select(
        "student_id", "course_id", "assignment_id", "submission_id", "submission_date", "graded_date",
        (graded_date - submission_date).alias("latency_seconds"),
        on_time(submission_date, graded_date, days).alias("on_time"),
    )


def attempts_on_time(
    t: LearningTables, course_ids: Sequence[int] | None = None, days: int = 8, open_end_at: int | None = None
) -> DataFrame:
    """student_id, course_id, on_time per attempt: true if all its (submission, grade) pairs are in time.

    Both sides are cut to their extreme dates per attempt first. All pairs are in time exactly when the last
    submission is no later than the first grade and the last grade is within the limit of the first submission, so
    repeated rows never multiply. The aggregation uses the partitioning that the join needs anyway. Users outside
    the roster are not dropped here but when the folded states meet it, so no raw row is shuffled by student.
    """
    submissions = (
        submissions_in_course(t, course_ids, open_end_at)
        .groupBy(*ATTEMPT, "course_id")
        .agg(
            F.min("submission_date").alias("first_submission"),
            F.max("submission_date").alias("last_submission"),
            F.max(F.coalesce(F.col("submission_date") == 0, F.lit(True))).alias("undated_submission"),
        )
    )
    grades = (
        grades_in_course(t, course_ids, open_end_at)
        .groupBy(*ATTEMPT)
        .agg(
            F.min("graded_date").alias("first_grade"),
            F.max("graded_date").alias("last_grade"),
            F.max(F.col("graded_date") == 0).alias("undated_grade"),
        )
    )
    limit = F.lit(int(days) * DAY).cast("long")
    timely = (
        ~F.col("undated_submission")
        & ~F.col("undated_grade")
        & (F.col("last_submission") <= F.col("first_grade"))
        & (F.col("last_grade") <= F.col("first_submission") + limit)
    )
    return submissions.join(grades, list(ATTEMPT), "left").select(
        "student_id", "course_id", F.coalesce(timely, F.lit(False)).alias("on_time")
    )


def low_grade_feedback(
    t: LearningTables,
    course_ids: Sequence[int] | None,
    threshold: float,
    keywords: Sequence[str],
    open_end_at: int | None = None,
    graded: DataFrame | None = None,
) -> DataFrame:
    """Evidence rows student_id, course_id, addressed: false for every low grade of a latest submission, and true for each
    comment on such a grade that holds a keyword.

    Comments are searched where they are read, and only the keys of those that hold a keyword go on: no text is shuffled. A bitmap
    of the courses' assignments keeps the search off other courses. Users outside the roster are dropped later, when the folded
    states meet it. `graded` are the rows of `graded_submissions`, if they are at hand; then a bitmap of the low grades keeps the search
    off all other comments, which are dropped where they are read.
    """
    is_low = F.col("grade") < F.lit(float(threshold))
    if graded is None:
        attempts = submissions_in_course(t, course_ids, open_end_at).select(*ATTEMPT, "course_id").distinct()
        low = grades_in_course(t, course_ids, open_end_at).filter(is_low).join(attempts, list(ATTEMPT))
    else:
        low = graded.filter(is_low)
    low = low.select("assignment_id", "grade_id", "student_id", "course_id")
    found = contains_any(F.col("commenttext"), keywords)
    if course_ids is not None:
        assignments = in_courses(t.assign, "course", course_ids).select("id")
        found = F.when(may_hold(key_bitmap(assignments, ("id",)), ("assignment",)), found).otherwise(False)
    comments = t.assignfeedback_comments
    if graded is not None:
        comments = comments.filter(may_hold(key_bitmap(low, ("assignment_id", "grade_id")), ("assignment", "grade")))
    comments = comments.filter(found).select(F.col("assignment").alias("assignment_id"), F.col("grade").alias("grade_id"))
    searched = comments.join(low, ["assignment_id", "grade_id"]).select("student_id", "course_id", F.lit(True).alias("addressed"))
    return low.select("student_id", "course_id", F.lit(False).alias("addressed")).unionByName(searched)
