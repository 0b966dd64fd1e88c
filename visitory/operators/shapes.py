"""The shapes of a query: aggregate, time series, breakdown, goals, realtime.

Each takes sessionized hits of one or more sites, already bounded by site, period and filters, and returns a DataFrame
with DOUBLE metrics. Sums are combined before each shuffle, so a value that a third of all hits share costs one row a
task.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import buckets, periods
from . import filters, metrics


def select(hits: DataFrame, domain: str | None = None, period: periods.Period | None = None, where: list | None = None, mode: str = "exact") -> DataFrame:
    """The hits of a site in a period that meet all filters. Hits of the store have their ``day``, which prunes files."""
    condition = F.lit(True)
    if domain is not None:
        condition = condition & (F.col("domain") == domain)
    if period is not None:
        condition = condition & periods.within(period, mode=mode)
        if "day" in hits.columns:
            condition = condition & F.col("day").between(*[F.lit(t.date()) for t in periods.outer(period)])
    return hits.filter(condition & filters.all_of(where or []))


def aggregate(hits: DataFrame, names=metrics.TOP) -> DataFrame:
    return metrics.measure(hits, [], names)


def timeseries(hits: DataFrame, interval: str, names=("visitors",)) -> DataFrame:
    """One row for each bucket with hits, by ``timestamp`` label in order."""
    made = metrics.measure(hits, [buckets.label(buckets.bucket(F.col("ts"), interval), interval).alias("timestamp")], names)
    return made.orderBy("timestamp")


def breakdown(hits: DataFrame, prop: str, names=("visitors",), limit: int | None = None, offset: int = 0) -> DataFrame:
    """One row for each value of a property, most visitors first and ties by value; null is no value."""
    name = filters.column(prop)
    wanted = list(dict.fromkeys([*names, "visitors"]))
    made = metrics.measure(hits.filter(F.col(name).isNotNull()), [F.col(name)], wanted).orderBy(F.desc("visitors"), name)
    if offset:
        made = made.offset(offset)
    if limit is not None:
        made = made.limit(limit)
    return made.select(name, *names)


def _against_all(rows: DataFrame, part: str, whole: str, out: str) -> DataFrame:
    """floor(part / sum of whole over all rows * 100), 0 without a sum. The sum is one row, joined without a window, so
    the groups do not meet in one task."""
    total = rows.agg(F.sum(whole).alias("_all"))
    share = F.when(F.col("_all") > 0, F.floor(F.col(part) / F.col("_all") * 100)).otherwise(0).cast("double")
    return rows.crossJoin(F.broadcast(total)).withColumn(out, share).drop("_all")


def breakdown_share(hits: DataFrame, prop: str) -> DataFrame:
    """Visitors of each value and their percentage of the sum over values."""
    name = filters.column(prop)
    rows = metrics.measure(hits.filter(F.col(name).isNotNull()), [F.col(name)], ["visitors"])
    return _against_all(rows, "visitors", "visitors", "percentage").orderBy(F.desc("visitors"), name)


def exit_pages(hits: DataFrame) -> DataFrame:
    """Visitors, visits and exit_rate (visits against all pageviews) of each exit page."""
    rows = metrics.measure(hits.filter("exit_page is not null"), [F.col("exit_page")], ["visitors", "visits", "pageviews"])
    return _against_all(rows, "visits", "pageviews", "exit_rate").select("exit_page", "visitors", "visits", "exit_rate").orderBy(F.desc("visitors"), "exit_page")


def goals(hits: DataFrame, goal_list: DataFrame) -> DataFrame:
    """Visitors and events of each goal of each site: event goals by name, page goals by page ("Visit ..." in the
    result). ``goal_list`` has domain, name, path."""
    names = goal_list.filter("name is not null").select("domain", F.col("name").alias("_wanted"), F.col("name").alias("goal"))
    paths = goal_list.filter("path is not null").select("domain", F.col("path").alias("_wanted"), F.concat(F.lit("Visit "), F.col("path")).alias("goal"))
    by_name = hits.join(names, (hits["domain"] == names["domain"]) & (hits["event"] == names["_wanted"])).select(hits["domain"], "goal", "id")
    by_path = hits.join(paths, (hits["domain"] == paths["domain"]) & (hits["page"] == paths["_wanted"])).select(hits["domain"], "goal", "id")
    both = by_name.unionByName(by_path)
    return both.groupBy("domain", "goal").agg(F.count_distinct("id").cast("double").alias("visitors"), F.count("*").cast("double").alias("events"))


def conversions(hits: DataFrame, goal_list: DataFrame) -> DataFrame:
    """Goals with conversion_rate: round(visitors / visitors of the site * 100)."""
    everyone = hits.groupBy("domain").agg(F.count_distinct("id").cast("double").alias("_all"))
    made = goals(hits, goal_list).join(everyone, "domain")
    rate = F.when(F.col("_all") > 0, F.round(F.col("visitors") / F.col("_all") * 100)).otherwise(0.0)
    return made.withColumn("conversion_rate", rate.cast("double")).drop("_all").orderBy("domain", F.desc("visitors"), "goal")


def realtime(hits: DataFrame, now: datetime) -> DataFrame:
    """Visitors of each site in the last five minutes, by whole minutes."""
    last = periods.Period(now - timedelta(minutes=5), now, "minute")
    return metrics.measure(hits.filter(periods.within(last)), ["domain"], ["visitors"])


def visitors_24h(hits: DataFrame, now: datetime) -> DataFrame:
    """Visitors of each site in the last 24 hours, by whole hours: one query for all sites."""
    last = periods.Period(now - timedelta(hours=24), now, "hour")
    return metrics.measure(hits.filter(periods.within(last)), ["domain"], ["visitors"])


def distinct_values(hits: DataFrame, prop: str, prefix: str = "", names: DataFrame | None = None) -> DataFrame:
    """Values of a property in byte order, as value and label; with ``prefix`` those that begin with it. ``names``
    (value, label) labels values such as country and region codes; the others are their own label."""
    col = F.col(filters.column(prop)).cast("string")
    rows = hits.select(col.alias("value")).filter(F.col("value").isNotNull() & F.col("value").startswith(prefix)).distinct()
    if names is None:
        return rows.select("value", F.col("value").alias("label")).orderBy("value")
    known = names.select("value", "label").dropDuplicates(["value"])
    return rows.join(known, "value", "left").select("value", F.coalesce("label", "value").alias("label")).orderBy("value")


def top_stats(hits: DataFrame, domain: str | None, period: periods.Period, how: str, now: datetime, where: list | None = None, by: list[str | Column] | None = None, names=metrics.TOP) -> DataFrame:
    """The metrics ``names`` (the six headline ones) with ``<metric>_change`` against the compared period; one pass over both periods."""
    before = periods.compared(period, how, now)
    rows = hits if domain is None else hits.filter(F.col("domain") == domain)
    is_now, is_before = periods.within(period), periods.within(before)
    rows = rows.filter((is_now | is_before) & filters.all_of(where or []))
    # a hit may fall in both where the periods overlap
    sides = F.filter(F.array(F.when(is_now, F.lit("now")), F.when(is_before, F.lit("before"))), lambda x: x.isNotNull())
    keys = by or []
    made = metrics.measure(rows.withColumn("side", F.explode(sides)), [*keys, "side"], names)
    wide = [F.coalesce(F.max(F.when(F.col("side") == s, F.col(m))), F.lit(0.0)).alias(f"{m}_{s}") for m in names for s in ("now", "before")]
    made = made.groupBy(*keys).agg(*wide)
    out = [c for m in names for c in (F.col(f"{m}_now").alias(m), metrics.change(m, F.col(f"{m}_now"), F.col(f"{m}_before")).alias(f"{m}_change"))]
    return made.select(*made.columns[: len(keys)], *out)
