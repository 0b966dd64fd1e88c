"""Stored visits kept up over loads: equal to one load, and untouched days stay."""

import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from visitory.operators import visits
from visitory.sources import upkeep, work

T = datetime(2024, 1, 1)
SCHEMA = "domain string, id long, seq long, ts timestamp_ntz, view boolean, event string, page string, host string, browser string"
OUT = ["domain", "id", "seq", "ts", "visit_start", "session", "bounce", "duration", "entry_page", "exit_page", "true_exit_page", "host", "sent_host", "browser"]


def _hits(seed, n=400):
    rnd = random.Random(seed)
    rows = []
    for i in range(6):
        at = T + timedelta(hours=rnd.randrange(30))
        for q in range(n // 6):
            at += timedelta(seconds=rnd.choice([0, 60, 600, 899, 900, 1200, 9000, 50000]))
            view = rnd.random() < 0.7
            rows.append((f"s{i % 2}", i // 2, i * 1000 + q, at, view, None if view else "x", f"/{rnd.randrange(5)}", "h", "b"))
    return rows


def _rows(df):
    return sorted(map(str, df.select(*OUT).collect()))


def _files(path):
    return {os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def _new(spark):
    return work.folder(spark, "store")


@pytest.mark.parametrize("seed", [1, 2])
def test_three_loads_equal_one(spark, seed):
    rows, rnd = _hits(seed), random.Random(seed)
    rnd.shuffle(rows)
    loads = [rows[:200], rows[200:230], rows[230:]]
    path = _new(spark)
    for load in loads:
        upkeep.add(spark.createDataFrame(load, SCHEMA), path)
    want = _rows(visits.visits(spark.createDataFrame(rows, SCHEMA).withColumn("sent_host", F.col("host"))))
    assert _rows(upkeep.read(spark, path)) == want
    # a load that comes again changes nothing
    upkeep.add(spark.createDataFrame(loads[1] + loads[1], SCHEMA), path)
    assert _rows(upkeep.read(spark, path)) == want


def test_untouched_days_stay(spark):
    rows = [("s", 1, k, T + timedelta(days=k, hours=12), True, None, "/a", "h", "b") for k in range(10)]
    rows += [("t", 1, 50 + k, T + timedelta(days=k, hours=12), True, None, "/a", "h", "b") for k in range(10)]
    path = _new(spark)
    upkeep.add(spark.createDataFrame(rows, SCHEMA), path)
    before = _files(path.removeprefix("file://"))
    late = [("s", 1, 99, T + timedelta(days=4, hours=12, minutes=5), False, "x", "/b", "h", "b")]
    assert upkeep.add(spark.createDataFrame(late, SCHEMA), path) == 1
    after = _files(path.removeprefix("file://"))
    gone = before - after
    assert gone and all("/domain=s/day=2024-01-05/" in f for f in gone) and all("/domain=s/day=2024-01-05/" in f for f in after - before)
    assert [(r.seq, r.session, r.bounce) for r in upkeep.read(spark, path).filter("domain = 's' and day = date'2024-01-05'").orderBy("seq").collect()] == [(4, True, 1), (99, False, -1)]


def test_a_stretch_over_days_is_read_back_to_its_pause(spark):
    """A hit that closes a gap joins two stretches of several days; the starts of all later visits move."""
    rows = [("s", 1, k, T + timedelta(minutes=10 * k), True, None, "/a", "h", "b") for k in range(144 * 7) if k != 400]
    path = _new(spark)
    upkeep.add(spark.createDataFrame(rows, SCHEMA), path)
    missing = [("s", 1, 400, T + timedelta(minutes=4000), True, None, "/a", "h", "b")]
    assert upkeep.add(spark.createDataFrame(missing, SCHEMA), path) > 1
    want = visits.visits(spark.createDataFrame(rows + missing, SCHEMA).withColumn("sent_host", F.col("host")))
    assert _rows(upkeep.read(spark, path)) == _rows(want)


def test_empty_loads(spark):
    path = _new(spark)
    some = [("s", 1, 1, T, True, None, "/a", "h", "b"), (None, 1, 2, T, True, None, "/a", "h", "b"), ("s", None, 3, T, True, None, "/a", "h", "b"), ("s", 1, 4, None, True, None, "/a", "h", "b")]
    upkeep.add(spark.createDataFrame(some, SCHEMA), path)
    assert upkeep.add(spark.createDataFrame([], SCHEMA), path) == 0
    assert upkeep.read(spark, path).count() == 1


def test_a_row_is_compared_with_few_stretches(spark, monkeypatch):
    """A visitor of very many stretches: rows meet stretches by the hour, and repeated hits of a first load count once."""
    rows = [("s", 1, k, T + timedelta(minutes=20 * k), True, None, "/a", "h", "b") for k in range(600)]
    late = [("s", 1, 1000 + k, T + timedelta(minutes=20 * k, seconds=5), False, "x", "/a", "h", "b") for k in range(600)]
    path, compared = _new(spark), []
    join = type(spark.range(1)).join

    def seen(self, other, on=None, how=None):
        if how == "left" and "first" in other.columns:
            compared.append(join(self, other, on[:-1], "inner").count())  # without the bounds
        return join(self, other, on, how)

    upkeep.add(spark.createDataFrame(rows + rows, SCHEMA), path)
    assert upkeep.read(spark, path).count() == 600
    with monkeypatch.context() as m:
        m.setattr(type(spark.range(1)), "join", seen)
        upkeep.add(spark.createDataFrame(late, SCHEMA), path)
    assert compared and max(compared) <= 5 * 1200
    want = visits.visits(spark.createDataFrame(rows + late, SCHEMA).withColumn("sent_host", F.col("host")))
    assert _rows(upkeep.read(spark, path)) == _rows(want)


def test_only_new_hits_are_written_beside_the_days(spark, monkeypatch):
    """Changed visits go straight to their days; of all columns nothing is written on the way but the new hits."""
    rows = [("s", 1, k, T + timedelta(minutes=5 * k), True, None, "/a", "h", "b") for k in range(0, 40, 2)]
    late = [("s", 1, k, T + timedelta(minutes=5 * k), True, None, "/b", "h", "b") for k in range(1, 40, 2)]
    path, wide = _new(spark), []
    upkeep.add(spark.createDataFrame(rows, SCHEMA), path)
    written = work.written
    monkeypatch.setattr(work, "written", lambda df, name: (wide.append(name) if "browser" in df.columns else None, written(df, name))[1])
    upkeep.add(spark.createDataFrame(late, SCHEMA), path)
    assert wide == ["fresh-hits"]
    assert _rows(upkeep.read(spark, path)) == _rows(visits.visits(spark.createDataFrame(rows + late, SCHEMA).withColumn("sent_host", F.col("host"))))
