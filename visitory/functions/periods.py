"""Periods of a query: names, dates and comparisons to bounds and an interval. No clock is read; ``now`` is given."""

from __future__ import annotations

import calendar
from dataclasses import dataclass, replace
from datetime import date, datetime, time, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import buckets

TICK = timedelta(microseconds=1)


@dataclass(frozen=True)
class Period:
    """Bounds, both included, and the interval of buckets."""

    start: datetime
    end: datetime
    interval: str


def day_start(d: date) -> datetime:
    return datetime.combine(d, time.min)


def day_end(d: date) -> datetime:
    return day_start(d) + timedelta(days=1) - TICK


def month_end(d: date) -> datetime:
    return day_end(date(d.year, d.month, calendar.monthrange(d.year, d.month)[1]))


def year_end(d: date) -> datetime:
    return day_end(date(d.year, 12, 31))


def months_back(d: date, n: int) -> date:
    """The first day of the month ``n`` months before."""
    k = d.year * 12 + d.month - 1 - n
    return date(k // 12, k % 12 + 1, 1)


def parse_dates(text: str | None) -> list[date]:
    """Dates of ``YYYY-MM-DD`` or ``from,to``; anything else is an error."""
    return [date.fromisoformat(x.strip()) for x in text.split(",")] if text else []


def period(name: str, now: datetime, dates: str | None = None, interval: str | None = None) -> Period:
    """The bounds of a named period that ends at the given date, or now without one."""
    given = parse_dates(dates)
    day = given[0] if given else now.date()
    end = day_end(day) if given else now
    if name == "realtime":
        floor = now.replace(second=0, microsecond=0)
        made = Period(floor - timedelta(minutes=15), now, "minute")
    elif name in ("7d", "30d"):
        made = Period(day_start(day - timedelta(days=6 if name == "7d" else 30)), end, "date")
    elif name == "month":
        made = Period(day_start(day.replace(day=1)), month_end(day), "date")
    elif name in ("6mo", "12mo"):
        made = Period(day_start(months_back(day, 5 if name == "6mo" else 11)), month_end(day), "month")
    elif name == "year":
        made = Period(datetime(day.year, 1, 1), year_end(day), "month")
    elif name == "all":
        made = Period(datetime(2000, 1, 1), end, "date")
    elif name == "custom":
        if len(given) != 2 or given[1] < given[0]:
            raise ValueError("a custom period needs two dates in order")
        made = Period(day_start(given[0]), day_end(given[1]), "hour")
    elif name in ("day", "", None):
        made = Period(day_start(day), end, "hour")
    else:
        raise ValueError(f"unknown period {name!r}")
    if interval:
        if interval not in buckets.INTERVALS:
            raise ValueError(f"unknown interval {interval!r}")
        made = replace(made, interval=interval)
    return made


def _year_back(t: datetime) -> datetime:
    return t.replace(year=t.year - 1, day=28) if (t.month, t.day) == (2, 29) else t.replace(year=t.year - 1)


def compared(p: Period, how: str, now: datetime) -> Period:
    """The period to hold ``p`` against: ``previous_period`` or ``year_over_year``."""
    if how == "previous_period":
        return replace(p, start=p.start - (p.end - p.start), end=p.start - TICK)
    if how == "year_over_year":
        return replace(p, start=_year_back(p.start), end=_year_back(min(p.end, now)))
    raise ValueError(f"unknown comparison {how!r}")


def within(p: Period, ts: str = "ts", mode: str = "exact") -> Column:
    """Whether a hit falls in the period. Plain bounds on ``ts``, so that scans can use them.

    ``exact`` takes whole buckets from the one that holds the start to the one that holds the end. ``compat`` leaves out
    the first if the period starts with it and adds the one after the last.
    """
    first, after = truncated(p.start, p.interval), following(truncated(p.end, p.interval), p.interval)
    if mode == "compat":
        first, after = following(first, p.interval), following(after, p.interval)
    elif mode != "exact":
        raise ValueError(f"unknown mode {mode!r}")
    return (F.col(ts) >= F.lit(first).cast("timestamp_ntz")) & (F.col(ts) < F.lit(after).cast("timestamp_ntz"))


def outer(p: Period) -> tuple[datetime, datetime]:
    """Instants that everything :func:`within` takes lies between, in either mode."""
    last = truncated(p.end, p.interval)
    return truncated(p.start, p.interval), following(following(last, p.interval), p.interval)


def truncated(t: datetime, interval: str) -> datetime:
    if interval == "minute":
        return t.replace(second=0, microsecond=0)
    if interval == "hour":
        return t.replace(minute=0, second=0, microsecond=0)
    day = day_start(t.date())
    if interval == "week":
        return day - timedelta(days=(day.weekday() + 1) % 7)
    return day.replace(day=1) if interval == "month" else day


def following(t: datetime, interval: str) -> datetime:
    """The start of the bucket after the one that starts at ``t``."""
    if interval == "month":
        return day_start(months_back(t.date(), -1))
    return t + {"minute": timedelta(minutes=1), "hour": timedelta(hours=1), "date": timedelta(days=1), "week": timedelta(days=7)}[interval]


def starts(p: Period) -> list[datetime]:
    """The starts of all buckets of the period."""
    at, out = truncated(p.start, p.interval), []
    while at <= p.end:
        out.append(at)
        at = following(at, p.interval)
    return out
