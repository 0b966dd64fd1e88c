"""The metrics of a group of hits: sums in one pass, ratios behind them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAMES = ("visitors", "visits", "pageviews", "views_per_visit", "bounce_rate", "visit_duration", "events")
TOP = NAMES[:6]
#: Metrics that plain hits have; the others need visits.
PLAIN = ("visitors", "pageviews", "events")
#: What a metric is made of.
_NEEDS = {
    "visitors": ("visitors",), "visits": ("visits",), "pageviews": ("pageviews",), "events": ("events",),
    "views_per_visit": ("pageviews", "visits"), "bounce_rate": ("_bounce", "visits"), "visit_duration": ("_duration", "visits"),
}


def check(names: Iterable[str]) -> list[str]:
    """The names as a list; an unknown one is an error."""
    names = list(names)
    for name in names:
        if name not in _NEEDS:
            raise ValueError(f"unknown metric {name!r}; known are {', '.join(NAMES)}")
    return names


def sums(names: Iterable[str]) -> list[Column]:
    made = {
        "visitors": F.count_distinct("id"),
        "visits": F.count_if(F.col("session")),
        "pageviews": F.count_if(F.col("view")),
        "events": F.count("*"),
        "_bounce": F.coalesce(F.sum("bounce"), F.lit(0)),
        "_duration": F.coalesce(F.sum("duration"), F.lit(0)),
    }
    needed = dict.fromkeys(n for name in check(names) for n in _NEEDS[name])
    return [made[n].cast("double").alias(n) for n in needed]


def ratio(name: str) -> Column:
    visits = F.col("visits")
    if name == "views_per_visit":
        out = F.when(visits != 0, F.round(F.col("pageviews") / visits)).otherwise(F.col("pageviews"))
    elif name == "bounce_rate":
        share = F.when(visits != 0, F.floor(F.col("_bounce") / visits * 100).cast("double")).otherwise(F.col("_bounce"))
        out = F.greatest(share, F.lit(0.0))
    elif name == "visit_duration":
        seconds = F.col("_duration") / 1e6
        out = F.floor(F.when(visits != 0, seconds / visits).otherwise(seconds))
    else:
        out = F.col(name)
    return out.cast("double").alias(name)


def measure(hits: DataFrame, by: list[Column | str], names: Iterable[str]) -> DataFrame:
    """One row for each group of ``by`` (one row in all without it) with the metrics ``names`` as DOUBLE."""
    names = check(names)
    grouped = hits.groupBy(*by).agg(*sums(names))
    keys = grouped.columns[: len(by)]
    return grouped.select(*keys, *map(ratio, names))


def change(name: str, now: Column, before: Column) -> Column:
    """The change against an earlier figure: points for bounce_rate, else percent, rounded half away from zero."""
    if name == "bounce_rate":
        return now - before
    return F.when((before == 0) & (now > 0), 100.0).when((before == 0) & (now == 0), 0.0).otherwise(F.round((now - before) / F.nullif(before, F.lit(0.0)) * 100)).cast("double")
