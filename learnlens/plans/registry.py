"""The allow-list of indicators: names, groups, defaults, filter controls and chart axes."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from learnlens.functions.periods import TimeRange
from learnlens.plans.settings import resolve_setting

TEACHER, STUDENT = "teacher", "student"


@dataclass(frozen=True)
class Axis:
    """Display settings of a bar chart; values beyond `high` are not cut in the data."""

    label: str
    step: int
    low: int | None = None
    high: int | None = None


@dataclass(frozen=True)
class IndicatorDef:
    id: str
    name: str
    group: str
    student_success: bool
    settings: Mapping[str, str] = field(default_factory=dict)  # argument -> setting
    has_time_range: bool = False
    axis: Axis | None = None  # None: pie chart

    def defaults(self, configured: Mapping[str, Any] | None = None) -> dict[str, Any]:
        """Default arguments, taken from the site settings."""
        configured = configured or {}
        values: dict[str, Any] = {"time_range": TimeRange.WEEKLY.value} if self.has_time_range else {}
        values.update({arg: resolve_setting(name, configured.get(name)) for arg, name in self.settings.items()})
        return values

    @property
    def control(self) -> dict[str, Any] | None:
        """The filter a reader of the chart can set, if any."""
        if not self.has_time_range:
            return None
        return {"name": "time_range", "options": [option.value for option in TimeRange]}


_CAP = {"sessioncap": "sessioncap"}

# Ids, names, groups and axes, in display order.
_DEFINITIONS = (
    IndicatorDef("course_performance_feedback", "Messaging Struggling Students (Low Grades)", TEACHER, True,
                 {"gradethreshold": "gradethreshold"}),
    IndicatorDef("personalized_feedback", "Personalized Feedback", TEACHER, True, {"feedbackgoal": "feedbackgoal"}),
    IndicatorDef("timely_feedback", "Timely Feedback", TEACHER, False, {"days": "timelyfeedbackdays"}),
    IndicatorDef("monitoring_forums", "Monitoring Forums", TEACHER, False),
    IndicatorDef("consistent-use-lms", "Consistent Use of LMS", TEACHER, False,
                 {"interactionthreshold": "interactionthreshold"}),
    IndicatorDef("login_frequency", "Login frequency", STUDENT, False, axis=Axis("Login Frequency", 5)),
    IndicatorDef("student_active_time", "Student active time", STUDENT, True, _CAP, True,
                 Axis("Hours Active", 1, 0, 24)),
    IndicatorDef("time_spent_forums", "Time spent viewing forums", STUDENT, True, _CAP, True,
                 Axis("Hours Spent Viewing Forums", 1, 0, 24)),
    IndicatorDef("time_spent_assignments", "Time spent on assignments", STUDENT, False, _CAP, True,
                 Axis("Hours Spent On Assignments", 10)),
    IndicatorDef("lo_access_frequency", "Learning object access frequency", STUDENT, False,
                 axis=Axis("Learning Objects Accessed", 10, 0, 100)),
    IndicatorDef("forum_posting_frequency", "Forum posting frequency", STUDENT, True,
                 axis=Axis("Number of Forum Postings", 10, 0, 100)),
    IndicatorDef("time_spent_lo", "Time spent accessing learning objects", STUDENT, True, _CAP, True,
                 Axis("Hours Spent Accessing Learning Objects", 1, 0, 24)),
    IndicatorDef("number_forums_viewed", "Number of forums viewed", STUDENT, True,
                 axis=Axis("Number of Forums Viewed", 10, 0, 100)),
)

INDICATORS: dict[str, IndicatorDef] = {definition.id: definition for definition in _DEFINITIONS}


def indicators_of(group: str) -> list[IndicatorDef]:
    return [definition for definition in INDICATORS.values() if definition.group == group]


def params_for_filter(indicator_id: str, value: str, configured: Mapping[str, Any] | None = None) -> dict[str, Any]:
    """Default arguments with the filter set to `value`, which must be one of the control's options."""
    definition = INDICATORS[indicator_id]
    control = definition.control
    if control is None or value not in control["options"]:
        raise ValueError(f"invalid filter value: {value!r}")
    return {**definition.defaults(configured), control["name"]: value}
