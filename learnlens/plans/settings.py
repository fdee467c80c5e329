"""Site settings: defaults, bounds and resolution on the driver, before any plan is built."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from learnlens.functions.periods import DAY, MINUTE


@dataclass(frozen=True)
class Setting:
    default: int | float
    low: int | float
    high: int | float


# Fixed values.
SETTINGS = {
    "gradethreshold": Setting(70.0, 0.0, 100.0),
    "feedbackgoal": Setting(60.0, 0.0, 100.0),
    "interactionthreshold": Setting(5.0, 0.0, float(2**63 - 1)),
    "timelyfeedbackdays": Setting(8, 0, 31),
    "sessioncap": Setting(30 * MINUTE, MINUTE, DAY),
}


def resolve_setting(name: str, configured: Any = None) -> int | float:
    """The configured value in the type of the default; missing, non-numeric or out of bounds gives the default."""
    if name not in SETTINGS:
        raise KeyError(f"unknown setting: {name}")
    rule = SETTINGS[name]
    try:
        value = float(configured)
    except (TypeError, ValueError):
        return rule.default
    if isinstance(configured, bool) or value != value or "_" in str(configured):
        return rule.default
    if isinstance(rule.default, int):
        value = int(value) if abs(value) != float("inf") else value
    return value if rule.low <= value <= rule.high else rule.default
