"""Which login led to which course view."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from learnlens.functions.periods import DAY
from learnlens.operators.activity import COURSE_VIEWED
from learnlens.operators.roster import course_roster
from learnlens.sources.tables import LearningTables

LOGGED_IN = r"\core\event\user_loggedin"
_SPREAD = 64


def login_seconds(t: LearningTables, course_ids: Sequence[int] | None = None) -> DataFrame:
    """Logins (without a course) and views of the chosen courses, reduced to distinct seconds: student_id, timecreated, course_id, is_view, login_id, day."""
    events = t.logstore_standard_log.filter(F.col("eventname").isin(LOGGED_IN, COURSE_VIEWED))
    if course_ids is not None:
        events = events.filter((F.col("eventname") == LOGGED_IN) | F.col("courseid").isin(list(course_ids)))
    is_login = F.col("eventname") == LOGGED_IN
    return (
        events.select(
            F.col("userid").alias("student_id"),
            "timecreated",
            F.when(~is_login, F.col("courseid")).alias("course_id"),
            F.when(is_login, F.col("id")).alias("login_id"),
            F.when(is_login, 0).otherwise(1).alias("is_view"),
        )
        .groupBy("student_id", "timecreated", "course_id", "is_view")
        .agg(F.max("login_id").alias("login_id"))
        .withColumn("day", F.expr(f"timecreated div {DAY}"))
    )


def login_course_access(
    t: LearningTables, as_of: int, course_ids: Sequence[int] | None = None, seconds: DataFrame | None = None
) -> DataFrame:
    """Distinct (student_id, login_id, login_time, course_id): a login inside the course window, followed before
    the user's next login by a view of that course. Open courses end at `as_of`; the view itself is not clipped.

    A view belongs to the latest login at or before it, by (time, id), so this is an as-of join. One user may own
    a third of the log, so it runs in two steps. First the events of one (user, day) are reduced to distinct seconds
    (`seconds`, if they are at hand) and ordered. Views with no earlier login that day are reduced to one row per (user, day, course) and meet
    one row per (user, day) with that day's last login. No window sees more than a day of (second, course)
    pairs, or one user's days.
    """
    seconds = login_seconds(t, course_ids) if seconds is None else seconds
    # Logins sort before views of the same second, so a view at the login's second counts for it.
    running = (
        W.partitionBy("student_id", "day")
        .orderBy("timecreated", "is_view")
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    login_time = F.when(F.col("is_view") == 0, F.col("timecreated"))
    views = (
        seconds.withColumns(
            {
                "seen_login": F.last("login_id", ignorenulls=True).over(running),
                "seen_time": F.last(login_time, ignorenulls=True).over(running),
            }
        )
        .filter(F.col("is_view") == 1)
        .groupBy("student_id", "day", "course_id", F.col("seen_login").alias("login_id"), F.col("seen_time").alias("login_time"))
        .agg(F.lit(1).alias("is_view"))
    )
    # The same reduced events give the last login of each day. No filter here: it would reach below the aggregate, and the
    # two uses would no longer share one scan and shuffle.
    day_logins = (
        seconds.groupBy("student_id", "day")
        .agg(F.max_by("login_id", login_time).alias("login_id"), F.max(login_time).alias("login_time"))
        .filter(F.col("login_time").isNotNull())
        .select(
            "student_id", "day", F.lit(None).cast("long").alias("course_id"), "login_id", "login_time",
            F.lit(2).alias("is_view"),
        )
    )
    # Settled views need no carried login and are spread out; only open views and day logins share a user's window.
    settled = (F.col("is_view") == 1) & F.col("login_id").isNotNull()
    slot = F.when(settled, F.pmod(F.col("login_id"), F.lit(_SPREAD))).otherwise(F.lit(-1))
    # Within a day open views (1) come before that day's last login (2): the carry is from strictly earlier days.
    carry = (
        W.partitionBy("student_id", "slot").orderBy("day", "is_view").rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    carried = (
        views.unionByName(day_logins)
        .withColumn("slot", slot)
        .withColumns(
            {
                "carried_login": F.last("login_id", ignorenulls=True).over(carry),
                "carried_time": F.last("login_time", ignorenulls=True).over(carry),
            }
        )
        .filter(F.col("is_view") == 1)
        .select(
            "student_id", "course_id",
            F.coalesce("login_id", "carried_login").alias("login_id"),
            F.coalesce("login_time", "carried_time").alias("login_time"),
        )
        .filter(F.col("login_id").isNotNull())
        .distinct()
    )
    roster = course_roster(t, course_ids, open_end_at=as_of)
    return (
        carried.join(roster, ["student_id", "course_id"])
        .filter(F.col("login_time").between(F.col("course_start"), F.col("course_end")))
        .select("student_id", "login_id", "login_time", "course_id")
    )
