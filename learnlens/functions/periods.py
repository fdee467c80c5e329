"""Reporting periods, resolved on the driver to the two ends of a closed window."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from enum import Enum
from zoneinfo import ZoneInfo

MINUTE, HOUR, DAY, WEEK = 60, 3600, 86400, 604800


class TimeRange(str, Enum):
    HOURLY = "hourly"
    DAILY = "daily"
    WEEKLY = "weekly"
    MONTHLY = "monthly"
    YEARLY = "yearly"


_SECONDS = {TimeRange.HOURLY: HOUR, TimeRange.DAILY: DAY, TimeRange.WEEKLY: WEEK}
_MONTHS = {TimeRange.MONTHLY: 1, TimeRange.YEARLY: 12}


def reporting_window(time_range: str | TimeRange | None, as_of: int, tz: str = "UTC") -> tuple[int, int]:
    """`(start, as_of)`; no range means weekly, an unknown one is an error."""
    try:
        chosen = TimeRange(time_range) if time_range is not None else TimeRange.WEEKLY
    except ValueError:
        raise ValueError(f"unsupported time range: {time_range!r}") from None
    if chosen in _SECONDS:
        return as_of - _SECONDS[chosen], as_of
    return _months_before(as_of, _MONTHS[chosen], ZoneInfo(tz)), as_of


def _months_before(moment: int, months: int, zone: ZoneInfo) -> int:
    """Same wall time `months` earlier; a day the month lacks runs on into the next month."""
    local = datetime.fromtimestamp(moment, tz=timezone.utc).astimezone(zone)
    count = local.year * 12 + (local.month - 1) - months
    first = datetime(count // 12, count % 12 + 1, 1, local.hour, local.minute, local.second)
    stepped = (first + timedelta(days=local.day - 1)).replace(tzinfo=zone)
    return int(stepped.timestamp())
