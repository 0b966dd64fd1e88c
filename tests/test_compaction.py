"""Many small batches made into few files, with the same rows before, during and after."""

import os
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from visitory.sources import compaction, store, work

T = datetime(2024, 1, 1)
SCHEMA = "domain string, id long, seq long, ts timestamp_ntz, page string"


def _files(path, name):
    return [os.path.join(d, f) for d, _, fs in os.walk(path.removeprefix("file://") + "/" + name) for f in fs if f.endswith(".parquet")]


def test_batches_become_few_files(spark):
    path = work.folder(spark, "store")
    rows = [("a" if k % 3 else "b", k % 17, k, T + timedelta(minutes=k * 7), "/x") for k in range(300)]
    schema = SCHEMA + ", day date"

    def put(numbers):
        for n in numbers:
            store.write(spark.createDataFrame(rows[n * 30 : (n + 1) * 30], SCHEMA), f"{path}/batch={n}", "overwrite")

    def seen():
        got = compaction.read(spark, path, schema)
        assert got.filter(F.col("day") != F.to_date("ts")).count() == 0
        return sorted(r.seq for r in got.collect())

    assert compaction.compact(spark, path, schema) == 0 and seen() == []
    put(range(6))
    assert seen() == list(range(180))
    before = compaction.read(spark, path, schema)  # a reader that began earlier
    many = sum(len(_files(path, f"batch={n}")) for n in range(6))
    assert compaction.compact(spark, path, schema, 100) == 6
    assert seen() == list(range(180)) == sorted(r.seq for r in before.collect())
    few = _files(path, "part=0-5")
    assert len(few) <= 8 < many and compaction.state(spark, path) == (5, ["part=0-5"])
    put(range(6, 10))
    assert seen() == list(range(300))
    # a compaction that fails before its list is named changes nothing
    spark.createDataFrame(rows[:5], SCHEMA).withColumn("day", F.to_date("ts")).write.partitionBy("domain", "day").parquet(f"{path}/part=6-7")
    assert seen() == list(range(300))
    assert compaction.compact(spark, path, schema) == 4 and seen() == list(range(300))
    assert compaction.clean(spark, path) == 11 and seen() == list(range(300))
    assert compaction.compact(spark, path, schema) == 0
    one = compaction.read(spark, path, schema).filter("domain = 'a' and day = date'2024-01-01'")
    assert one.count() == sum(r[0] == "a" and r[3].date() == T.date() for r in rows)
    assert "PartitionFilters: [isnotnull(domain" in one._jdf.queryExecution().toString()
