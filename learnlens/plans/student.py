"""The eight student indicators."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from learnlens.functions.gaps import gap_or_null, gap_or_zero, least_gap
from learnlens.functions.periods import reporting_window
from learnlens.operators import activity, assessment, counts, facts, logins, summaries
from learnlens.operators.numbering import BY_COURSE_STUDENT, BY_STUDENT, BY_STUDENT_COURSE, number_rows
from learnlens.operators.roster import course_roster
from learnlens.plans.settings import SETTINGS
from learnlens.sources.tables import LearningTables

SESSION_CAP = SETTINGS["sessioncap"].default


@dataclass(frozen=True)
class StudentParams:
    """Arguments shared by the student indicators. `as_of` is the clock; nothing reads the system time.

    `summaries` are stored day summaries (`operators.summaries`) of the same session cap, which cover the whole days of the period: capped times are merged
    from them, and the log is read for the days at the period's ends only. `shared` takes the totals from the two passes of `facts`, for a job that holds most of the indicators.
    """

    as_of: int
    course_ids: Sequence[int] | None = None
    time_range: str | None = None
    sessioncap: int = SESSION_CAP
    tz: str = "UTC"
    open_end_at: int | None = None
    shared: bool = False
    summaries: DataFrame | None = None

    @property
    def window(self) -> tuple[int, int]:
        return reporting_window(self.time_range, self.as_of, self.tz)


@dataclass(frozen=True)
class StudentIndicator:
    """How an indicator's rows are found, numbered and sorted. `totals` gives (keys, total) without the roster."""

    value: str
    totals: Callable[[LearningTables, StudentParams], DataFrame]
    record_order: tuple[str, ...] | None
    sort_order: tuple[str, ...]
    in_hours: bool = False
    fill_roster: bool = True


def _seconds(t: LearningTables, p: StudentParams) -> DataFrame:
    events = facts.moments if p.shared else activity.activity_seconds
    return events(t, *p.window, p.course_ids, p.open_end_at)


def _merged(t: LearningTables, p: StudentParams) -> DataFrame:
    """All capped times at once, from stored day summaries or from the shared pass."""
    if p.summaries is not None:
        days = summaries.period_days(t, p.summaries, *p.window, p.sessioncap, p.course_ids, p.open_end_at)
    else:
        days = summaries.days_of(_seconds(t, p), p.sessioncap)
    return summaries.merged_totals(days, p.sessioncap)


def _capped(t: LearningTables, p: StudentParams, bit: int, gap: activity.Gap) -> DataFrame:
    if p.summaries is not None or p.shared:
        return _merged(t, p).withColumnRenamed(summaries.TOTALS[bit], "total")
    return activity.capped_totals(_seconds(t, p), bit, gap, p.sessioncap)


def _active_time(t: LearningTables, p: StudentParams) -> DataFrame:
    return _capped(t, p, activity.ACTIVE, gap_or_null)


def _forum_time(t: LearningTables, p: StudentParams) -> DataFrame:
    return _capped(t, p, activity.FORUM_VIEW, gap_or_zero).filter("saw_forum")


def _object_time(t: LearningTables, p: StudentParams) -> DataFrame:
    return _capped(t, p, activity.LEARNING_OBJECT_VIEW, least_gap)


def _assignment_time(t: LearningTables, p: StudentParams) -> DataFrame:
    if p.shared:
        return facts.assignment_totals(_seconds(t, p))
    return assessment.assignment_totals(t, *p.window, p.course_ids, p.open_end_at)


def _accesses(t: LearningTables, p: StudentParams) -> DataFrame:
    if p.shared:
        return facts.view_totals(facts.history(t, p.course_ids)).withColumnRenamed("accesses", "total")
    return counts.learning_object_accesses(t, p.course_ids)


def _discussions(t: LearningTables, p: StudentParams) -> DataFrame:
    if p.shared:
        return facts.view_totals(facts.history(t, p.course_ids)).withColumnRenamed("discussions", "total")
    return counts.discussions_viewed(t, p.course_ids)


def _logins(t: LearningTables, p: StudentParams) -> DataFrame:
    seconds = facts.login_seconds(facts.history(t, p.course_ids)) if p.shared else None
    # A login that reached several courses counts once.
    return (
        logins.login_course_access(t, p.as_of, p.course_ids, seconds)
        .groupBy("student_id")
        .agg(F.countDistinct("login_id").alias("total"))
    )


STUDENT_INDICATORS: dict[str, StudentIndicator] = {
    "login_frequency": StudentIndicator("login_frequency", _logins, None, BY_STUDENT),
    "student_active_time": StudentIndicator(
        "active_time_seconds", _active_time, BY_COURSE_STUDENT, BY_STUDENT_COURSE, in_hours=True
    ),
    "time_spent_forums": StudentIndicator(
        "total_seconds_spent", _forum_time, BY_STUDENT_COURSE, BY_STUDENT_COURSE, in_hours=True, fill_roster=False
    ),
    "time_spent_assignments": StudentIndicator(
        "assignment_time_seconds", _assignment_time, BY_STUDENT_COURSE, BY_STUDENT_COURSE, in_hours=True
    ),
    "lo_access_frequency": StudentIndicator(
        "learning_object_access_frequency",
        _accesses,
        BY_COURSE_STUDENT,
        BY_STUDENT_COURSE,
    ),
    "forum_posting_frequency": StudentIndicator(
        "forum_post_frequency",
        lambda t, p: counts.forum_posts_written(t, p.course_ids),
        BY_COURSE_STUDENT,
        BY_COURSE_STUDENT,
    ),
    "time_spent_lo": StudentIndicator(
        "learning_object_view_time_seconds", _object_time, BY_COURSE_STUDENT, BY_COURSE_STUDENT, in_hours=True
    ),
    "number_forums_viewed": StudentIndicator(
        "forums_viewed_count",
        _discussions,
        BY_COURSE_STUDENT,
        BY_COURSE_STUDENT,
    ),
}


def _keys(spec: StudentIndicator) -> list[str]:
    return sorted(spec.sort_order, reverse=True)  # the student first


def roster_rows(t: LearningTables, keys: Sequence[str], course_ids: Sequence[int] | None) -> DataFrame:
    """The distinct keys of the enrolled students."""
    roster = course_roster(t, course_ids).select(*keys)
    return roster if "course_id" in keys else roster.distinct()


def student_totals(t: LearningTables, indicator_id: str, p: StudentParams) -> DataFrame:
    """Keys and value of the students for whom the log has something to count."""
    spec = STUDENT_INDICATORS[indicator_id]
    return spec.totals(t, p).select(*_keys(spec), F.col("total").alias(spec.value))


#: What a wide frame of all totals takes from one source: its columns, by indicator.
_TIMES = {"student_active_time": "active", "time_spent_lo": "object"}
_VIEWS = {"lo_access_frequency": "accesses", "number_forums_viewed": "discussions"}


def wide_totals(t: LearningTables, params: Mapping[str, StudentParams]) -> list[DataFrame]:
    """Frames by (student_id, course_id) that hold the values of the given indicators, one frame per source of the shared passes.

    The parameters of the indicators agree, as those of a dashboard do.
    """
    frames = []
    for names, source in ((_TIMES, _merged), (_VIEWS, lambda t, p: facts.view_totals(facts.history(t, p.course_ids)))):
        own = [i for i in names if i in params]
        if own:
            found = source(t, params[own[0]])
            frames.append(found.select("student_id", "course_id", *[F.col(names[i]).alias(STUDENT_INDICATORS[i].value) for i in own]))
    return frames + [student_totals(t, i, p) for i, p in params.items() if i not in _TIMES and i not in _VIEWS]


def student_rows(
    t: LearningTables, indicator_id: str, p: StudentParams, order: Sequence[str] | None, number: str = "recordid"
) -> DataFrame:
    """Unsorted rows of an indicator: keys, value and, with `order`, their number in that order.

    The narrow roster is numbered before the totals are joined to it, so the totals are computed once.
    """
    spec = STUDENT_INDICATORS[indicator_id]
    keys = _keys(spec)
    totals = student_totals(t, indicator_id, p)
    roster = roster_rows(t, keys, p.course_ids)
    if spec.fill_roster:
        rows = roster if order is None else number_rows(roster, order, number)
        value = F.coalesce(spec.value, F.lit(0).cast("long"))
        joined = rows.join(totals, keys, "left")
    else:
        found = totals.join(roster, keys, "left_semi")
        joined = found if order is None else number_rows(found, order, number, counted=spec.value)
        value = F.col(spec.value)
    numbers = [] if order is None else [number]
    return joined.select(*numbers, *keys, value.alias(spec.value))


def _indicator(t: LearningTables, indicator_id: str, p: StudentParams) -> DataFrame:
    spec = STUDENT_INDICATORS[indicator_id]
    return student_rows(t, indicator_id, p, spec.record_order).orderBy(*spec.sort_order)


def login_frequency(t: LearningTables, as_of: int, course_ids: Sequence[int] | None = None) -> DataFrame:
    """Logins that led to a chosen course, per student over all chosen courses."""
    return _indicator(t, "login_frequency", StudentParams(as_of, course_ids))


def student_active_time(t: LearningTables, as_of: int, course_ids: Sequence[int] | None = None, **options) -> DataFrame:
    """Capped seconds after active events. Options: time_range, sessioncap, tz, open_end_at, summaries."""
    return _indicator(t, "student_active_time", StudentParams(as_of, course_ids, **options))


def time_spent_forums(t: LearningTables, as_of: int, course_ids: Sequence[int] | None = None, **options) -> DataFrame:
    """Capped seconds after forum views; students without a forum view have no row."""
    return _indicator(t, "time_spent_forums", StudentParams(as_of, course_ids, **options))


def time_spent_assignments(
    t: LearningTables, as_of: int, course_ids: Sequence[int] | None = None, **options
) -> DataFrame:
    """Seconds from first view to first submission, summed over assignment modules. The session cap has no effect."""
    return _indicator(t, "time_spent_assignments", StudentParams(as_of, course_ids, **options))


def lo_access_frequency(t: LearningTables, course_ids: Sequence[int] | None = None) -> DataFrame:
    """Views of learning objects, all time."""
    return _indicator(t, "lo_access_frequency", StudentParams(0, course_ids))


def forum_posting_frequency(t: LearningTables, course_ids: Sequence[int] | None = None) -> DataFrame:
    """Forum posts, all time."""
    return _indicator(t, "forum_posting_frequency", StudentParams(0, course_ids))


def time_spent_lo(t: LearningTables, as_of: int, course_ids: Sequence[int] | None = None, **options) -> DataFrame:
    """Capped seconds after views of resources, urls, pages and lessons."""
    return _indicator(t, "time_spent_lo", StudentParams(as_of, course_ids, **options))


def number_forums_viewed(t: LearningTables, course_ids: Sequence[int] | None = None) -> DataFrame:
    """Distinct discussions viewed, all time."""
    return _indicator(t, "number_forums_viewed", StudentParams(0, course_ids))
