"""Visits by hand, against a plain state machine, and as a stream."""

import json
import random
import uuid
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from visitory.operators import lookups, metrics, visits
from visitory.sources import payload, store
from visitory.streaming import visits as stream

T = datetime(2024, 1, 1)
SCHEMA = "domain string, id long, seq long, ts timestamp_ntz, view boolean, event string, page string, host string"
HAND = [  # offset in seconds, view, page; session, bounce, duration, entry, exit
    (0, True, "/a", True, 1, 0, "/a", "/a"),
    (240, False, "/a", False, -1, 240, "/a", "/a"),
    (540, True, "/b", False, 0, 300, "/a", "/b"),
    (899, True, "/c", False, 0, 359, "/a", "/c"),
    (900, True, "/d", True, 1, 0, "/d", "/d"),
    (1799, False, "/e", False, -1, 899, "/d", "/d"),
    (1800, False, "/e", True, 1, 0, None, None),
]


def _hand(spark):
    rows = [("s", 1, k, T + timedelta(seconds=o), v, None if v else "x", p, "h") for k, (o, v, p, *_) in enumerate(HAND)]
    return spark.createDataFrame(rows, SCHEMA)


def test_by_hand(spark):
    got = visits.visits(_hand(spark)).orderBy("seq").collect()
    assert [(r.session, r.bounce, r.duration // 1_000_000, r.entry_page, r.exit_page) for r in got] == [
        (s, b, d, e, x) for _, _, _, s, b, d, e, x in HAND
    ]
    row = metrics.measure(visits.visits(_hand(spark)), [], metrics.NAMES).first()
    assert (row.visitors, row.visits, row.pageviews, row.views_per_visit, row.bounce_rate, row.visit_duration, row.events) == (1, 3, 4, 1, 33, 599, 7)


def _plain(rows):
    state, out = {}, {}
    for d, i, q, ts, *_ in sorted(rows, key=lambda r: (r[3], r[2])):
        start = state.get((d, i))
        if start is None or ts - start >= timedelta(minutes=15):
            start = state[d, i] = ts
        out[d, i, q] = start
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_starts_equal_a_state_machine(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(6):
        at = T
        for q in range(150):
            at += timedelta(seconds=rnd.choice([0, 1, 60, 400, 899, 900, 901, 3000, 20000]))
            rows.append((f"s{i % 2}", i // 2, i * 1000 + q, at, True, None, "/a", "h"))
    got = visits.visit_starts(spark.createDataFrame(rows, SCHEMA)).select("domain", "id", "seq", F.timestamp_micros("visit_start").alias("s")).collect()
    assert {(r.domain, r.id, r.seq): r.s for r in got} == _plain(rows)
    assert len(got) == len(rows)


def test_empty(spark):
    assert visits.visits(spark.createDataFrame([], SCHEMA)).count() == 0


def test_stream_equals_batch(spark):
    from visitory.sources.store import read

    base = spark.conf.get("spark.checkpoint.dir") + "/" + uuid.uuid4().hex
    _hand(spark).write.parquet(base + "/in")
    rows = spark.readStream.schema(SCHEMA).parquet(base + "/in")
    made = stream.visits(rows)
    q = made.writeStream.foreachBatch(lambda b, _: store.write(b, base + "/out")).option("checkpointLocation", base + "/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = read(spark, base + "/out").orderBy("seq").collect()
    assert [(r.session, r.bounce, r.duration // 1_000_000, r.entry_page, r.exit_page) for r in got] == [(s, b, d, e, x) for _, _, _, s, b, d, e, x in HAND]
    plan = store.of(read(spark, base + "/out"), "s", T.date(), T.date())._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(domain" in plan or "domain" in plan.split("PartitionFilters")[1][:200]


def test_ingest_stream_to_store(spark):
    base = spark.conf.get("spark.checkpoint.dir") + "/" + uuid.uuid4().hex
    agent = "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0.0.0 Safari/537.36"
    sent = [
        {"n": "pageview", "u": "https://www.a.org/x?utm_source=Mail", "d": "a.org", "ts": 1704067200000, "remote_ip": "10.0.0.9", "user_agent": agent, "headers": {"x-real-ip": "1.0.16.0"}},
        {"name": "signup", "url": "https://a.org/y", "domain": "a.org,b.org", "ts": 1704067260000, "remote_ip": "1.0.16.0", "user_agent": agent},
        {"name": "pageview", "url": "https://a.org/y", "domain": "nobody.org", "ts": 1704067260000, "remote_ip": "1.0.16.0", "user_agent": agent},
        {"name": "pageview", "url": "https://a.org/y", "domain": "a.org", "ts": 1704067260000, "remote_ip": "1.0.16.0", "user_agent": "Googlebot/2.1"},
    ]
    spark.createDataFrame([(json.dumps(x),) for x in sent], "value string").write.text(base + "/in")
    ranges = spark.createDataFrame([(16777216, 16842751, "JP", None, None), (16781312, 16785407, "JP", "13", 7)], "low long, high long, country string, subdivision1_code string, city int")
    known = spark.createDataFrame([("a.org",)], "domain string")
    valid, refused = payload.split(payload.stream(spark, base + "/in"))
    assert refused.isStreaming
    made = stream.visits(payload.enriched(valid, known, ranges))
    stream.sink(made, base + "/out", base + "/cp", None).awaitTermination(120)
    got = store.read(spark, base + "/out").orderBy("ts").collect()
    assert [(r.domain, r.view, r.page, r.session, r.batch) for r in got] == [("a.org", True, "/x", True, 0), ("a.org", False, "/y", False, 0)]
    # a batch that is run again replaces itself
    again = spark.createDataFrame(got, store.read(spark, base + "/out").schema).drop("batch", "day")
    store.write(again, base + "/out/batch=0", "overwrite")
    assert store.read(spark, base + "/out").count() == 2


def test_counts_on_a_stream(spark):
    base = spark.conf.get("spark.checkpoint.dir") + "/" + uuid.uuid4().hex
    _hand(spark).write.parquet(base + "/in")
    name = "counts" + uuid.uuid4().hex
    made = stream.counts(spark.readStream.schema(SCHEMA).parquet(base + "/in"), "10 minutes")
    q = made.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r.pageviews for r in spark.table(name).orderBy("window.start").collect()] == [2, 2, 0, 0]


def test_narrowest_range(spark):
    rnd = random.Random(3)
    ranges = [(a := rnd.randrange(300_000), a + rnd.choice([0, 5, 255, 70_000, 200_000]), f"c{k}", f"r{k}", k) for k in range(30)]
    made = lookups.with_place(spark.createDataFrame([(f"0.{n >> 16}.{n >> 8 & 255}.{n & 255}", n) for n in rnd.sample(range(400_000), 300)] + [("x", -1), (None, -2)], "remote_ip string, n long"), spark.createDataFrame(ranges, "low long, high long, country string, subdivision1_code string, city int"))
    got = made.collect()
    assert len(got) == 302
    for r in got:
        around = [x for x in ranges if r.n >= 0 and x[0] <= r.n <= x[1]]
        narrow = min((x[1] - x[0], x[0]) for x in around) if around else None
        assert r.country in ([x[2] for x in around if (x[1] - x[0], x[0]) == narrow] if around else [None])
