"""Time buckets. All times are UTC; weeks start on Sunday."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INTERVALS = ("minute", "hour", "date", "week", "month")


def bucket(ts: Column, interval: str) -> Column:
    """The start of the bucket that holds ``ts``, as TIMESTAMP_NTZ."""
    if interval == "week":
        day = F.expr("INTERVAL 1 DAY")
        return (F.date_trunc("week", ts + day).cast("timestamp_ntz") - day).cast("timestamp_ntz")
    unit = {"minute": "minute", "hour": "hour", "date": "day", "month": "month"}.get(interval)
    if unit is None:
        raise ValueError(f"unknown interval {interval!r}; known are {', '.join(INTERVALS)}")
    return F.date_trunc(unit, ts).cast("timestamp_ntz")


def label(start: Column, interval: str) -> Column:
    return F.date_format(start, "yyyy-MM-dd" if interval in ("week", "month") else "yyyy-MM-dd HH:mm:ss")
