"""Tables that grow by loads: values, agents, sets of visitors by minute."""

import os
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from visitory.functions import agent
from visitory.plans import catalog
from visitory.schema import HIT
from visitory.sources import agents, dictionary, work
from visitory.streaming import realtime

T = datetime(2024, 1, 1)
COLUMNS = [c.split()[0] for c in HIT.split(", ")]


def _hits(spark, rows):
    made = [tuple({"domain": d, "id": i, "seq": k, "ts": T + timedelta(seconds=s), "view": True, "page": p}.get(c) for c in COLUMNS) for k, (d, i, s, p) in enumerate(rows)]
    return spark.createDataFrame(made, HIT)


def _files(path):
    return {os.path.join(d, f) for d, _, fs in os.walk(path.removeprefix("file://")) for f in fs if f.endswith(".parquet")}


def test_dictionary_grows(spark):
    path = work.folder(spark, "dictionary")
    dictionary.grow(_hits(spark, [("a", 1, 50, "/x"), ("a", 1, 60, "/y"), ("b", 1, 70, "/x"), (None, 1, 1, "/n")]), path, ["page", "source"])
    before = _files(path)
    dictionary.grow(_hits(spark, [("a", 2, 55, "/x"), ("b", 2, 80, "/xé"), ("b", 2, 90, None)]), path, ["page", "source"])
    after = _files(path)
    assert all("domain=b" in f for f in before - after) and any("domain=a" in f for f in before & after)
    dictionary.grow(_hits(spark, [("b", 2, 80, "/xé")]), path, ["page", "source"])  # again
    assert _files(path) == after
    dictionary.grow(_hits(spark, [("a", 2, 5, "/x")]), path, ["page", "source"])  # late, but earlier
    known = dictionary.read(spark, path)
    assert {(r.prop, r.domain, r.value): (r["first"] - T).seconds for r in known.collect()} == {("page", "a", "/x"): 5, ("page", "a", "/y"): 60, ("page", "b", "/x"): 70, ("page", "b", "/xé"): 80, ("site", "a", ""): 5, ("site", "b", ""): 70}
    assert [r.value for r in dictionary.values(known, "b", "event:page", "/x").collect()] == ["/x", "/xé"]
    assert dictionary.values(known, "b", "source").count() == 0
    sites = spark.createDataFrame([("a",), ("z",)], "domain string")
    assert {r.domain: r.seen for r in dictionary.seen_first(known, sites).collect()} == {"a": True, "z": False}
    plan = dictionary.values(known, "a", "page", "/x")._jdf.queryExecution().toString()
    assert "StringStartsWith(value,/x)" in plan and "PartitionFilters: [isnotnull(prop" in plan
    none = work.folder(spark, "dictionary")
    dictionary.grow(_hits(spark, []), none)
    dictionary.grow(_hits(spark, [("a", 1, 1, "/x")]), none)
    assert {r.prop for r in dictionary.read(spark, none).collect()} == {"page", "site"}


def test_each_agent_is_parsed_once(spark):
    texts = [a[0] for a in catalog.AGENTS] + [None, "", "odd"]
    rows = spark.createDataFrame([(k, texts[k % len(texts)]) for k in range(90)], "k long, user_agent string")
    path = work.folder(spark, "agents")
    assert agents.grow(rows.filter("k < 4"), path) == 4
    assert agents.grow(rows, path) == len(texts) - 1 - 4
    assert agents.grow(rows, path) == 0
    assert spark.read.parquet(path).count() == len(texts) - 1
    names = ["k", *agents.PARSED]
    got = agents.with_agents(rows, agents.read(spark, path)).select(*names)
    assert sorted(map(str, got.collect())) == sorted(map(str, agent.parsed(rows).select(*names).collect()))
    lone = work.folder(spark, "agents")
    assert agents.grow(rows.limit(0), lone) == 0
    left = agents.with_agents(rows, agents.read(spark, lone)).select(*names).collect()
    assert len(left) == 90 and not any(r.bot for r in left)
    # joined as it is to a stream
    rows.write.parquet(path + "-in")
    stream = agents.with_agents(spark.readStream.schema(rows.schema).parquet(path + "-in"), agents.read(spark, path)).select(*names)
    stream.writeStream.foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(path + "-out")).option("checkpointLocation", path + "-cp").trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(map(str, spark.read.parquet(path + "-out").collect())) == sorted(map(str, got.collect()))


def test_realtime_figures(spark):
    rows = [("a" if k % 4 else "b", [1, 2, 40_000, 3_000_000_000][k * 7 % 4], k * 23 % 1500, "/x") for k in range(400)]
    hits, base = _hits(spark, rows), work.folder(spark, "realtime")
    ordered = hits.orderBy("ts").collect()
    for k in range(3):
        spark.createDataFrame(ordered[k * 140 : (k + 1) * 140], HIT).coalesce(1).write.mode("append").parquet(base + "/in")
    stream = spark.readStream.schema(HIT).option("maxFilesPerTrigger", 1).parquet(base + "/in")
    realtime.keep(realtime.sets(stream), base + "/sets", base + "/cp", None).awaitTermination(120)
    got = {(r.domain, r.minute): (r.visitors, r.pageviews) for r in realtime.figures(realtime.read(spark, base + "/sets")).collect()}
    want = {}
    for d, i, s, _ in rows:
        for k in range(5):
            want.setdefault((d, T + timedelta(minutes=s // 60 + k)), []).append(i)
    assert got == {k: (len(set(v)), len(v)) for k, v in want.items()}
    # the batch over the same hits
    assert {(r.domain, r.minute): (r.visitors, r.pageviews) for r in realtime.figures(realtime.sets(hits)).collect()} == got
    assert len({r.chunk for r in realtime.sets(hits.filter(F.col("domain") == "a")).collect()}) == 3
