"""Two shared passes over the log, from which all student indicators of a dashboard are taken.

`moments` is what happened inside a reporting period, `history` what counts for all time. Each is one scan and one shuffle with partial aggregation
below it; every indicator is a view of their rows. So that no filter and no pruning of one indicator makes its scan and shuffle differ from the
others', kinds are aggregate outputs and not grouping columns, ids are never null (`MISSING` stands for none, so a join infers no filter), and a
condition that always holds keeps all columns in every use. Alone, an indicator is cheaper from its own narrow scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from learnlens.functions.periods import DAY
from learnlens.operators.activity import ANY_FORUM_VIEW, COURSE_VIEWED, FORUM_VIEW, clip_to_course, event_kind, log_between
from learnlens.operators.assessment import ASSIGNMENT_SUBMITTED, ASSIGNMENT_VIEWED
from learnlens.operators.counts import DISCUSSION_VIEWED, MODULE_VIEWS
from learnlens.operators.logins import LOGGED_IN
from learnlens.operators.roster import course_windows
from learnlens.sources.tables import LearningTables

# More bits of a moment's kind, beside those of an event's: some event of it was such a view or submission.
_VIEWED, _SUBMITTED = 16, 32
# Classes of history.
LOGIN, COURSE_VIEW, MODULE_VIEW, DISCUSSION_VIEW = range(4)
MISSING = -(2**63)  # an id that no row has


def _id(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(MISSING)).alias(column)


def _all_used(df: DataFrame, *columns: str) -> DataFrame:
    """`df` with a condition that holds for every row and reads the columns, none of which an indicator then prunes."""
    holds = F.lit(True)
    for column in columns:
        holds &= F.coalesce(F.col(column) >= F.lit(MISSING), F.col(columns[0]).isNotNull())
    return df.filter(holds)


def moments(
    t: LearningTables, start: int, end: int, course_ids: Sequence[int] | None = None, open_end_at: int | None = None
) -> DataFrame:
    """One row per (student_id, course_id, second, assignment module) with an event inside both windows: kind, last_id, day.

    `module_id` is missing for all events that are no view or submission of an assignment. `kind` has the bits of the last event by id, and those of any.
    A student's second may have several rows; ordered by (timecreated, last_id) the last one is that of the second's last event, so gaps
    to the next row are those to the next event.
    """
    module = F.col("contextinstanceid")
    viewed, submitted = ((F.col("eventname") == name) & module.isNotNull() for name in (ASSIGNMENT_VIEWED, ASSIGNMENT_SUBMITTED))
    kind = event_kind() + F.when(viewed, _VIEWED).when(submitted, _SUBMITTED).otherwise(0)
    events = clip_to_course(log_between(t, course_ids, start, end), course_windows(t, course_ids, open_end_at))
    found = (
        events.select("userid", "course_id", "timecreated", "id", kind.alias("kind"), F.when(viewed | submitted, module).alias("module_id"))
        .groupBy(F.col("userid").alias("student_id"), "course_id", "timecreated", "module_id")
        .agg(F.max_by("kind", "id").alias("last"), F.bit_or("kind").alias("any"), F.max("id").alias("last_id"))
    )
    last = F.coalesce("last", F.lit(0)).bitwiseAND(_VIEWED - 1)  # null where no event of the second has an id
    some = F.col("any").bitwiseAND(_VIEWED | _SUBMITTED) + F.when(F.col("any").bitwiseAND(FORUM_VIEW) > 0, ANY_FORUM_VIEW).otherwise(0)
    rows = found.select(_id("student_id"), _id("course_id"), "timecreated", _id("module_id"), "last_id", F.expr(f"timecreated div {DAY}").alias("day"), (last + some).alias("kind"))
    return _all_used(rows, "kind", "last_id")


def assignment_totals(found: DataFrame) -> DataFrame:
    """student_id, course_id, total: seconds from the first view of each assignment module to the first submission after it, from `moments`."""
    module = ["student_id", "course_id", "module_id"]
    has = lambda bit: found.filter(F.col("kind").bitwiseAND(bit) > 0)
    views = has(_VIEWED).groupBy(*module).agg(F.min("timecreated").alias("first_view_time"))
    submits = has(_SUBMITTED).select(*module, F.col("timecreated").alias("submit_time"))
    return (
        submits.join(views, module)
        .filter(F.col("submit_time") >= F.col("first_view_time"))
        .groupBy(*module, "first_view_time")
        .agg(F.min("submit_time").alias("first_submit_time"))
        .groupBy("student_id", "course_id")
        .agg(F.sum(F.col("first_submit_time") - F.col("first_view_time")).alias("total"))
    )


def history(t: LearningTables, course_ids: Sequence[int] | None = None) -> DataFrame:
    """student_id, course_id, kind, at, n, login_id, all time: a row per login second and course-view second (`at` is the second, logins have no
    course), per viewed discussion (`at` is its id), and one for all views of modules (`at` is null). `n` counts events.
    """
    event = F.col("eventname")
    log = t.logstore_standard_log.filter(event.isin(LOGGED_IN, COURSE_VIEWED, DISCUSSION_VIEWED, *MODULE_VIEWS))
    if course_ids is not None:
        log = log.filter((event == LOGGED_IN) | F.col("courseid").isin(list(course_ids)))
    kind = F.when(event == LOGGED_IN, LOGIN).when(event == COURSE_VIEWED, COURSE_VIEW).when(event == DISCUSSION_VIEWED, DISCUSSION_VIEW).otherwise(MODULE_VIEW)
    at = F.when(kind <= COURSE_VIEW, F.col("timecreated")).when(kind == DISCUSSION_VIEW, F.col("objectid"))
    rows = (
        log.select(F.col("userid").alias("student_id"), F.when(event != LOGGED_IN, F.col("courseid")).alias("course_id"), kind.alias("class"), at.alias("at"), "id")
        .groupBy("student_id", "course_id", "class", "at")
        .agg(F.max("class").alias("kind"), F.count("id").alias("n"), F.max(F.when(F.col("class") == LOGIN, F.col("id"))).alias("login_id"))
        .select(_id("student_id"), _id("course_id"), "at", "kind", "n", "login_id")
    )
    return _all_used(rows, "kind", "n", "login_id")


def login_seconds(found: DataFrame) -> DataFrame:
    """The rows of `logins.login_seconds`, from `history`."""
    return found.filter(F.col("kind") <= COURSE_VIEW).select(
        "student_id", F.col("at").alias("timecreated"), "course_id", F.col("kind").alias("is_view"), "login_id", F.expr(f"at div {DAY}").alias("day")
    )


def view_totals(found: DataFrame) -> DataFrame:
    """student_id, course_id, accesses, discussions: views of learning objects and distinct discussions viewed, from `history`."""
    kind = F.col("kind")
    rows = (
        found.filter(kind >= MODULE_VIEW)
        .groupBy("student_id", "course_id")
        .agg(F.sum(F.when(kind == MODULE_VIEW, F.col("n")).otherwise(0)).alias("accesses"), F.count(F.when(kind == DISCUSSION_VIEW, F.col("at"))).alias("discussions"))
    )
    return _all_used(rows, "accesses", "discussions")
