"""Visit starts by pointers against the state machine, in stretches without a pause."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from visitory.operators import pointers, visits

T = datetime(2024, 1, 1)
SCHEMA = "domain string, id long, seq long, ts timestamp_ntz, view boolean, event string, page string, host string"


def _plain(times):
    start, out = None, []
    for at in times:
        if start is None or at - start >= timedelta(minutes=15):
            start = at
        out.append(start)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_a_state_machine(spark, seed):
    rnd, rows, want = random.Random(seed), [], {}
    for i in range(4):
        at, times = T + timedelta(minutes=rnd.randrange(60)), []
        for _ in range(500):
            at += timedelta(microseconds=rnd.choice([0, 1, 10_000_000, 300_000_000, 899_999_999, 900_000_000, 5_000_000_000]))
            times.append(at)
        rows += [(f"s{i % 2}", i // 2, i * 1000 + k, t, True, None, "/a", "h") for k, t in enumerate(times)]
        want |= {i * 1000 + k: s for k, s in enumerate(_plain(times))}
    hits = spark.createDataFrame(rows, SCHEMA)
    for most in (0, 3, 200, None):
        got = visits.visit_starts(hits, most=most).select("seq", F.timestamp_micros("visit_start").alias("s")).collect()
        assert len(got) == 2000 and {r.seq: r.s for r in got} == want


def test_one_long_stretch_spreads_over_tasks(spark):
    n = 60_000  # one visitor, a hit every five seconds or so for three days
    us = F.lit(1704067200000000) + F.col("id") * 5_000_000 + F.pmod(F.xxhash64("id"), F.lit(4_000_000))
    hits = spark.range(n).select(F.lit("s").alias("domain"), F.lit(1).cast("long").alias("id"), F.col("id").alias("seq"), F.timestamp_micros(us).cast("timestamp_ntz").alias("ts"))
    got = visits.visit_starts(hits, most=10_000).select("seq", "ts", F.timestamp_micros("visit_start").alias("s")).orderBy("ts").collect()
    assert [r.s for r in got] == _plain([r.ts for r in got])
    instants = hits.select("domain", "id", F.lit(1704067200000000).alias("_stretch"), F.unix_micros(F.col("ts").cast("timestamp")).alias("_us"))
    sizes = [r.n for r in pointers.next_starts(instants, visits.WINDOW_US).groupBy(F.floor(F.col("at") / pointers.HOUR)).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) > 80 and max(sizes) < n / 50  # an hour at a time
    assert visits.visit_starts(hits.limit(0), most=10).count() == 0
