"""Streamed visits in order of event time: equal to the batch on every column, however hits arrive."""

import random
import uuid
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from visitory.operators import visits
from visitory.schema import HIT
from visitory.sources import work
from visitory.streaming import settled

T = datetime(2024, 1, 1)
COLUMNS = [c.split()[0] for c in HIT.split(", ")]


def _hits(seed, n):
    rnd, rows = random.Random(seed), []
    for i in range(5):
        at = T
        for q in range(n):
            at += timedelta(seconds=rnd.choice([0, 1, 60, 400, 899, 900, 901, 3000]))
            view = rnd.random() < 0.7
            own = {"domain": f"s{i % 2}", "id": i // 2, "seq": i * 1000 + q, "ts": at, "view": view, "event": None if view else "x", "page": rnd.choice(["/a", "/b", None]), "host": "h", "city": 7, "browser": f"b{q % 3}"}
            rows.append(tuple(own.get(c) if c in own else f"{c}{q % 4}" for c in COLUMNS))
    return rows


@pytest.mark.parametrize("seed", [1])
def test_shuffled_stream_equals_batch(spark, seed):
    rows, rnd = _hits(seed, 60), random.Random(seed)
    arrival = sorted((r[3] + timedelta(minutes=rnd.uniform(0, 50)), k) for k, r in enumerate(rows))
    base = work.folder(spark, "stream")
    step = -(-len(rows) // 4)
    for k in range(4):
        part = [rows[j] for _, j in arrival[k * step : (k + 1) * step]]
        again = [rows[j] for _, j in arrival[max(0, k * step - 5) : k * step]]  # some come twice
        spark.createDataFrame(part + again, HIT).coalesce(1).write.mode("append").parquet(base + "/in")
    end = tuple({"domain": "end", "id": 0, "seq": 0, "ts": T + timedelta(days=30), "view": True}.get(c) for c in COLUMNS)
    spark.createDataFrame([end], HIT).coalesce(1).write.mode("append").parquet(base + "/in")
    settled.prepare(spark)
    stream = spark.readStream.schema(HIT).option("maxFilesPerTrigger", 1).parquet(base + "/in")
    made = settled.visits(stream, "1 hour")
    out = base + "/out" + uuid.uuid4().hex
    made.writeStream.foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{out}/batch={n}")).option("checkpointLocation", base + "/cp").trigger(availableNow=True).start().awaitTermination(300)
    got = spark.read.parquet(out).drop("batch")
    want = visits.visits(spark.createDataFrame(rows, HIT)).select(*got.columns)
    assert set(COLUMNS) < set(got.columns) and "true_exit_page" in got.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


class _Held:
    """A list or value of the state, and how many elements were handed to it."""

    def __init__(self):
        self.all, self.calls = [], 0

    def appendValue(self, value):
        self.all.append(value)
        self.calls += 1

    def put(self, values):
        self.all, self.calls = list(values), self.calls + len(values)

    def get(self):
        return iter(self.all)

    def clear(self):
        self.all = []


class _Due:
    value = None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


class _Handle:
    def __init__(self):
        self.waiting, self.timers = _Held(), set()

    def getListState(self, name, schema):
        return self.waiting

    def getValueState(self, name, schema):
        return _Due()

    def registerTimer(self, ms):
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.timers.discard(ms)


class _Watermark:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_hits_wait_in_pieces_and_come_out_once():
    """A batch hands the state one element for 1,000 hits, and hits that come again are dropped when they are settled."""
    handle, made = _Handle(), settled.Settled(["seq", "_us", "_seen", "_body"], 900_000_000)
    made.init(handle)
    cells = Row("_at", "_us", "seq", "_seen", "_body")
    rows = [cells(None, k * 1_000_000, k, f"/{k}", "{}") for k in range(2500)]
    list(made.handleInputRows(("s", 1), iter(rows), _Watermark(0)))
    list(made.handleInputRows(("s", 1), iter(rows[2000:2100] + [cells(None, 3_600_000_000, None, None, "{}")] * 2), _Watermark(0)))
    assert handle.waiting.calls == 4 and handle.timers == {900_000}
    out = list(made.handleExpiredTimer(("s", 1), _Watermark(3_000_000), None))
    assert len(out) == 2500 and [r.visit_start for r in out if r.n == 0] == [0, 900_000_000, 1_800_000_000]
    assert handle.waiting.calls == 5 and 4_500_000 in handle.timers  # the last hit waits on, once
    assert [r._us for r in made.handleExpiredTimer(("s", 1), _Watermark(4_500_000), None)] == [3_600_000_000] and not handle.waiting.all


def test_columns_of_a_hit_do_not_cross_one_by_one(spark):
    """Texts, numbers and flags come back as they were through one JSON text, other types beside it."""
    schema = "domain string, id long, seq long, ts timestamp_ntz, view boolean, page string, host string, odd string, much long, half double, day date"
    rows = [("s", 1, 1, T, True, "/a\n\"'\\ é😀", "h", "", 2**63 - 1, float("nan"), T.date()), ("s", 1, 2, T + timedelta(seconds=1, microseconds=7), False, None, "h", None, None, None, None)]
    base = work.folder(spark, "stream")
    spark.createDataFrame(rows, schema).write.parquet(base + "/in")
    settled.prepare(spark)
    made = settled.visits(spark.readStream.schema(schema).parquet(base + "/in"))
    made.writeStream.foreachBatch(lambda b, n: b.write.mode("append").parquet(base + "/out")).option("checkpointLocation", base + "/cp").trigger(availableNow=True).start().awaitTermination(120)
    end = [("t", 1, 3, T + timedelta(days=1), True, "/", "h", None, None, None, None)]
    spark.createDataFrame(end, schema).write.mode("append").parquet(base + "/in")
    made.writeStream.foreachBatch(lambda b, n: b.write.mode("append").parquet(base + "/out")).option("checkpointLocation", base + "/cp").trigger(availableNow=True).start().awaitTermination(120)
    want = visits.visits(spark.createDataFrame(rows, schema)).select(*made.columns)
    assert sorted(map(str, spark.read.parquet(base + "/out").collect())) == sorted(map(str, want.collect()))
