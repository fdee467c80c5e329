"""Capped time between an event and the one after it. The three forms differ in how they treat a last event."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def gap_or_null(time: Column, next_time: Column, cap: int) -> Column:
    """Gap cut at `cap`; null when there is no next event."""
    gap = next_time - time
    # `least` skips nulls in Spark and would turn a missing gap into a full cap.
    return F.when(gap > cap, F.lit(cap).cast("long")).otherwise(gap)


def gap_or_zero(time: Column, next_time: Column, cap: int) -> Column:
    """Gap cut at `cap`; 0 when there is no next event."""
    gap = next_time - time
    return F.when(next_time.isNull(), F.lit(0).cast("long")).when(gap > cap, F.lit(cap).cast("long")).otherwise(gap)


def least_gap(time: Column, next_time: Column, cap: int) -> Column:
    """The smaller of `cap` and the gap, a missing gap counting as 0."""
    return F.least(F.coalesce(next_time - time, F.lit(0).cast("long")), F.lit(cap).cast("long"))
