"""The registered queries: every indicator, step and series, each over the whole tables of the given Parquet folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from learnlens import oracle
from learnlens.functions.gaps import gap_or_null, gap_or_zero, least_gap
from learnlens.functions.periods import DAY, TimeRange, reporting_window
from learnlens.functions.text import IMPROVEMENT_KEYWORDS, RESOLUTION_KEYWORDS, contains_any
from learnlens.operators import activity, assessment, forum, logins, roster, summaries, uniqueness, weekly
from learnlens.plans import student, teacher
from learnlens.plans.dashboard import dashboard, refresh
from learnlens.plans.registry import STUDENT, TEACHER
from learnlens.plans.series import bar_series, state_counts, teacher_states
from learnlens.plans.student import STUDENT_INDICATORS, StudentParams
from learnlens.session import tune
from learnlens.sources.sample import AS_OF, sample_tables
from learnlens.sources.tables import LearningTables

Query = Callable[[SparkSession, str], DataFrame]
Build = Callable[[SparkSession, LearningTables], DataFrame]

WINDOWED = ("student_active_time", "time_spent_forums", "time_spent_assignments", "time_spent_lo")
CAPPED = ("student_active_time", "time_spent_forums", "time_spent_lo")
LONG_CAP = 43200
SOME_COURSES = (1, 3, 8, 12)


def _on_sample(build: Build) -> Query:
    return lambda spark, sf_dir: build(tune(spark), sample_tables(spark, sf_dir))


def _student(indicator_id: str, **options) -> Build:
    function = getattr(student, indicator_id)
    clock = (AS_OF,) if indicator_id in (*WINDOWED, "login_frequency") else ()
    return lambda spark, t: function(t, *clock, **options)


def _teacher(indicator_id: str, **options) -> Build:
    return lambda spark, t: teacher_states(t, indicator_id, AS_OF, **options)


def _capped_gaps(t: LearningTables) -> DataFrame:
    events = activity.next_event_time(activity.windowed_log(t, *reporting_window("weekly", AS_OF)))
    forms = {"gap_or_null": gap_or_null, "gap_or_zero": gap_or_zero, "least_gap": least_gap}
    return events.select(
        "event_id", "student_id", "course_id",
        *[form(F.col("timecreated"), F.col("next_event_time"), 1800).alias(name) for name, form in forms.items()],
    )


def _steps() -> dict[str, Build]:
    def week(t: LearningTables) -> DataFrame:
        return activity.windowed_log(t, *reporting_window("weekly", AS_OF))

    def month(t: LearningTables) -> DataFrame:
        return activity.windowed_log(t, *reporting_window("monthly", AS_OF))

    return {
        "course_roster": lambda s, t: roster.course_roster(t),
        "teacher_roster": lambda s, t: roster.teacher_roster(t, AS_OF),
        "course_participants": lambda s, t: roster.course_participants(t),
        "windowed_log": lambda s, t: week(t),
        "teacher_events": lambda s, t: activity.teacher_events(t, AS_OF),
        "next_event_time": lambda s, t: activity.next_event_time(month(t)).select(
            "event_id", "student_id", "course_id", "timecreated", "next_event_time"
        ),
        "capped_gaps": lambda s, t: _capped_gaps(t),
        "login_course_access": lambda s, t: logins.login_course_access(t, AS_OF),
        "assignment_durations": lambda s, t: assessment.assignment_durations(t, *reporting_window("monthly", AS_OF)),
        "latest_submissions": lambda s, t: assessment.latest_submissions(t),
        "graded_submissions": lambda s, t: assessment.graded_submissions(t).select(
            "submission_id", "assignment_id", "student_id", "course_id", "attempt_number", "submission_date",
            "grade_id", "grade", "graded_date",
        ),
        "feedback_records": lambda s, t: assessment.feedback_records(t).select(
            "submission_id", "assignment_id", "student_id", "course_id", "grade_id", "grade", "feedback_id",
            "feedback_text",
        ),
        "improvement_comments": lambda s, t: t.assignfeedback_comments.select(
            F.col("id").alias("feedback_id"),
            contains_any(F.col("commenttext"), IMPROVEMENT_KEYWORDS).alias("has_keyword"),
        ),
        "resolution_posts": lambda s, t: t.forum_posts.select(
            F.col("id").alias("post_id"), contains_any(F.col("message"), RESOLUTION_KEYWORDS).alias("has_keyword")
        ),
        "participant_posts": lambda s, t: forum.participant_posts(t),
        "resolved_chains": lambda s, t: forum.resolved_chains(t),
        "feedback_uniqueness": lambda s, t: uniqueness.feedback_uniqueness(t),
        "feedback_latency": lambda s, t: assessment.feedback_latency(t),
        "weekly_interactions": lambda s, t: weekly.weekly_interactions(t, AS_OF),
        "teacher_consistency": lambda s, t: weekly.teacher_consistency(t, AS_OF, threshold=2),
        "user_courses": lambda s, t: roster.user_courses(t, selected_ids=(1, 2, 3)),
    }


def _registered() -> dict[str, tuple[Build, str]]:
    """name -> (Spark job, DuckDB SQL)."""
    entries: dict[str, tuple[Build, str]] = {}
    for name in STUDENT_INDICATORS:
        entries[name] = (_student(name), oracle.student_indicator(name))
        entries[f"{name}_series"] = (
            lambda s, t, name=name: bar_series(t, name, StudentParams(AS_OF)), oracle.bar_series(name)
        )
        entries[f"{name}_courses"] = (
            _student(name, course_ids=SOME_COURSES), oracle.in_courses(oracle.student_indicator(name), SOME_COURSES)
        )
    for name in WINDOWED:
        for period in (p.value for p in TimeRange):
            entries[f"{name}_{period}"] = (
                _student(name, time_range=period), oracle.student_indicator(name, time_range=period)
            )
            entries[f"{name}_refresh_{period}"] = (
                lambda s, t, name=name, period=period: refresh(s, t, name, SOME_COURSES, period, AS_OF),
                oracle.in_courses(oracle.bar_series(name, time_range=period), SOME_COURSES),
            )
        # The month of a user in another time zone, where it begins a day later.
        entries[f"{name}_monthly_in_new_york"] = (
            lambda s, t, name=name: getattr(student, name)(t, oracle.NEW_YORK_CLOCK, time_range="monthly", tz="America/New_York"),
            oracle.student_indicator(name, time_range=oracle.IN_NEW_YORK),
        )
        # An open course that ends at the clock, over a month: open courses have no window otherwise.
        entries[f"{name}_open_end"] = (
            _student(name, time_range="monthly", open_end_at=AS_OF), oracle.with_open_end(oracle.student_indicator(name, time_range="monthly"))
        )
    # Refreshed from day summaries of all days before the clock's, as a caller stores them; the SQL is that of the raw form.
    for name in CAPPED:
        for period in ("weekly", "monthly", "yearly"):
            entries[f"{name}_refresh_{period}_from_summaries"] = (
                lambda s, t, name=name, period=period: refresh(
                    s, t, name, SOME_COURSES, period, AS_OF, summaries=summaries.day_summaries(t, 0, AS_OF // DAY, student.SESSION_CAP)
                ),
                oracle.in_courses(oracle.bar_series(name, time_range=period), SOME_COURSES),
            )
    for name in CAPPED:
        entries[f"{name}_long_cap"] = (
            _student(name, time_range="monthly", sessioncap=LONG_CAP),
            oracle.student_indicator(name, time_range="monthly", cap=LONG_CAP),
        )
    variants = {
        "course_performance_feedback": ("gradethreshold", (50.0,)),
        "personalized_feedback": ("feedbackgoal", (20.0, 80.0)),
        "timely_feedback": ("days", (3,)),
        "monitoring_forums": ("", ()),
        "consistent-use-lms": ("interactionthreshold", (1.0, 2.0)),
    }
    for name, (setting, values) in variants.items():
        key = name.replace("-", "_")
        entries[key] = (_teacher(name), oracle.teacher_indicator(name))
        entries[f"{key}_courses"] = (
            _teacher(name, course_ids=SOME_COURSES), oracle.in_courses(oracle.teacher_indicator(name), SOME_COURSES)
        )
        entries[f"{key}_counts"] = (
            lambda s, t, name=name: state_counts(s, teacher_states(t, name, AS_OF)), oracle.state_counts(name)
        )
        for value in values:
            entries[f"{key}_{setting}_{value:g}"] = (
                _teacher(name, **{setting: value}), oracle.teacher_indicator(name, **{setting: value})
            )
    step_sql = oracle.steps()
    for name, build in _steps().items():
        entries[name] = (build, step_sql[name])
    entries["dashboard"] = (lambda s, t: dashboard(s, t, AS_OF), oracle.dashboard())
    settings = {"gradethreshold": 50.0, "feedbackgoal": 40.0, "timelyfeedbackdays": 3, "interactionthreshold": 1.0, "sessioncap": 600}
    entries["dashboard_students"] = (
        lambda s, t: dashboard(s, t, AS_OF, SOME_COURSES, group=STUDENT), oracle.in_courses(oracle.dashboard(group=STUDENT), SOME_COURSES)
    )
    entries["dashboard_configured_teachers"] = (
        lambda s, t: dashboard(s, t, AS_OF, configured=settings, group=TEACHER), oracle.dashboard(group=TEACHER, configured=settings)
    )
    return entries


def queries() -> dict[str, Query]:
    return {name: _on_sample(build) for name, (build, _) in _registered().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _registered().items()}
