"""Rollups against the metrics of the hits themselves."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from visitory.operators import metrics, rollup, shapes, visits
from visitory.sources import work

T = datetime(2024, 1, 30)
SCHEMA = "domain string, id long, seq long, ts timestamp_ntz, view boolean, event string, page string, host string, city int"
PROPS = ("page", "entry_page", "event", "city")


@pytest.fixture(scope="module")
def hits(spark):
    rnd, rows = random.Random(4), []
    for q in range(6000):  # site "a" has enough visitors for bitmaps, "b" has few and far numbers
        site = "a" if q % 3 else "b"
        who = rnd.randrange(3000) if site == "a" else rnd.choice([0, 1, 32768, 32769, 10**9, 2**32 - 1, 5 * 10**12])
        view = rnd.random() < 0.8
        rows.append((site, who, q, T + timedelta(minutes=rnd.randrange(60 * 24 * 4)), view, None if view else "buy", rnd.choice(["/a", "/b", None]), "h", rnd.choice([None, 7, 9])))
    made = visits.visits(spark.createDataFrame(rows, SCHEMA)).select("domain", "id", "seq", "ts", "session", "view", "bounce", "duration", *PROPS)
    return work.written(made, "hits")


def _rows(df):
    return sorted((tuple(r.asDict().items()) for r in df.collect()), key=str)


def _same(a, b):
    assert a.columns == b.columns and _rows(a) == _rows(b)


def test_equals_hits(hits):
    made = rollup.of(hits, "hour", PROPS).kept()
    assert made.ids.filter("bitmap is not null").count() == 0
    coarse = rollup.merged(made, "month").kept()
    assert coarse.ids.filter("bitmap is not null").count() > 0 and coarse.ids.filter("places is not null").count() > 0
    for r in (made, coarse):
        _same(rollup.aggregate(r, metrics.NAMES), shapes.aggregate(hits, metrics.NAMES))
        _same(rollup.aggregate(r, metrics.NAMES, ["domain"]), metrics.measure(hits, ["domain"], metrics.NAMES))
        for p in ("entry_page", "city"):
            _same(rollup.breakdown(r, p, metrics.NAMES), shapes.breakdown(hits, p, metrics.NAMES))
    for i in ("hour", "week"):
        _same(rollup.timeseries(made, i, metrics.NAMES), shapes.timeseries(hits, i, metrics.NAMES))
    _same(rollup.timeseries(coarse, "month", metrics.NAMES), shapes.timeseries(hits, "month", metrics.NAMES))
    _same(rollup.breakdown(made, "page", ["pageviews"], 1), shapes.breakdown(hits, "page", ["pageviews"], 1))


def test_loads_add_up(spark, hits, monkeypatch):
    monkeypatch.setattr(rollup, "SPARSE", 300)
    path = work.folder(spark, "rollup")
    parts = [hits.filter("seq % 2 = 0"), hits.filter("seq % 2 = 1")]
    for k, part in enumerate(parts):
        rollup.write(rollup.merged(rollup.of(part, "hour", ["entry_page"]), "date"), path, "date", f"load{k}")
    rollup.write(rollup.merged(rollup.of(parts[1], "hour", ["entry_page"]), "date"), path, "date", "load1")  # a retry
    read = rollup.read(spark, path, "date")
    dense = rollup.of(parts[0], "month", ["entry_page"]).union(rollup.merged(rollup.of(parts[1], "hour", ["entry_page"]), "month")).kept()
    assert dense.ids.filter("bitmap is not null").count() > 0
    for r in (read, rollup.merged(read, "month").kept(), rollup.merged(dense).kept()):
        _same(rollup.aggregate(r, metrics.NAMES, ["domain"]), metrics.measure(hits, ["domain"], metrics.NAMES))
        _same(rollup.breakdown(r, "entry_page", metrics.NAMES), shapes.breakdown(hits, "entry_page", metrics.NAMES))
    month = read.where((F.col("month") == F.lit("2024-02-01").cast("date")) & (F.col("domain") == "a"))
    plan = month.sums._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "month" in plan.split("PartitionFilters")[1][:200]
    _same(rollup.aggregate(month, metrics.NAMES), shapes.aggregate(hits.filter("domain = 'a' and ts >= '2024-02-01'"), metrics.NAMES))


def test_mixed_containers_count_once(spark):
    points = spark.range(2000).select(F.lit("a").alias("domain"), (F.col("id") + 1).alias("id"))
    cells = points.select("domain", F.lit(T).cast("timestamp_ntz").alias("ts"), "id", F.lit(True).alias("session"), F.lit(True).alias("view"), F.lit(1).alias("bounce"), F.lit(0).cast("long").alias("duration"))
    whole = rollup.of(cells, "date", [])
    few = rollup.of(cells.filter("id % 100 = 0").unionByName(cells.limit(1).withColumn("id", F.lit(5000).cast("long"))), "date", [])
    assert whole.ids.filter("bitmap is not null").count() == 1 and few.ids.filter("bitmap is not null").count() == 0
    for r in (whole.union(few), rollup.merged(whole.union(few))):
        assert rollup.aggregate(r, ["visitors"]).first().visitors == 2001


def test_empty(hits):
    none = rollup.of(hits.limit(0), "hour", PROPS)
    _same(rollup.aggregate(none, metrics.NAMES), shapes.aggregate(hits.limit(0), metrics.NAMES))
    assert rollup.breakdown(none, "page").count() == 0 and rollup.merged(none, "date").ids.count() == 0
    with pytest.raises(ValueError):
        rollup.aggregate(none, ["nonsense"])
