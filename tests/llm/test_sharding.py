"""The uniform shuffle: exact sizes, gapless slots, the law of its matrix, and odd inputs."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from visitory.llm import sharding

DOC = "doc_id long, text string, shard string, row string, slot map<string,int>"


def test_hypergeometric_follows_its_law():
    rnd = random.Random(5)
    for good, bad, draws in ((30, 50, 20), (5, 3, 6), (1000, 9000, 500)):
        got = [sharding.hypergeometric(rnd, good, bad, draws) for _ in range(20_000)]
        mean = draws * good / (good + bad)
        spread = mean * (1 - good / (good + bad)) * (good + bad - draws) / (good + bad - 1)
        assert abs(np.mean(got) - mean) < 5 * (spread / 20_000) ** 0.5
        assert abs(np.var(got) / spread - 1) < 0.06
        assert max(0, draws - bad) <= min(got) and max(got) <= min(draws, good)
    assert sharding.hypergeometric(rnd, 0, 9, 4) == 0 and sharding.hypergeometric(rnd, 9, 0, 4) == 4
    # counts of a very large corpus
    n = sharding.hypergeometric(rnd, 12_500_000_000, 87_500_000_000, 50_000_000)
    assert abs(n - 6_250_000) < 8 * 2340


def test_matrix_adds_up():
    rnd = random.Random(6)
    counts = [rnd.randrange(40) for _ in range(50)]
    n = sum(counts)
    sizes = [n // 7 + (k < n % 7) for k in range(7)]
    made = sharding.matrix(counts, sizes, rnd)
    assert [sum(r) for r in made] == counts and [sum(c) for c in zip(*made, strict=True)] == sizes


def _holds(rows, shards):
    by = Counter(r.shard for r in rows)
    n = len(rows)
    assert [by.get(k, 0) for k in range(shards)] == [n // shards + (k < n % shards) for k in range(shards)]
    for k in range(shards):
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(by.get(k, 0)))


def test_documents(spark):
    rnd = random.Random(7)
    rows = [(k, rnd.choice(["a", "é" * rnd.randrange(9), "", None, "hot"]), "x", "y", {"k": k}) for k in range(997)]
    rows += [(None, "hot", "x", None, None)] * 40 + [(5, "twice", "x", "y", {})] * 3
    docs = spark.createDataFrame(rows, DOC)
    got = sharding.assignments(docs).collect()
    _holds(got, 8)
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    assert {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}


def test_does_not_depend_on_partitions(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id")).alias("text"))
    one, many = ({(r.doc_id, r.shard, r.slot) for r in sharding.assignments(docs.repartition(n)).collect()} for n in (1, 13))
    assert one == many
    assert one != {(r.doc_id, r.shard, r.slot) for r in sharding.assignments(docs, seed=14).collect()}


def test_every_place_is_as_likely(spark):
    """Places of 4,000 rows: shard against remainder of the id, and slot against id, are independent."""
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("same").alias("text"))
    got = sharding.assignments(docs, 5).collect()
    table = np.zeros((5, 4))
    for r in got:
        table[r.shard, r.doc_id % 4] += 1
    expected = table.sum(1, keepdims=True) * table.sum(0, keepdims=True) / table.sum()
    assert ((table - expected) ** 2 / expected).sum() < 32.9  # 0.1 % of 12 degrees of freedom
    assert abs(np.corrcoef([r.slot for r in got], [r.doc_id for r in got])[0, 1]) < 0.06


@pytest.mark.parametrize("n", [0, 1, 3])
def test_few_rows(spark, n):
    docs = spark.createDataFrame([(k, "t", "x", "y", None) for k in range(n)], DOC)
    _holds(sharding.assignments(docs).collect(), 8)


def test_whole_rows_and_files(spark):
    docs = spark.createDataFrame([(k, f"t{k}", "x", str(k), {"k": k}) for k in range(50)], DOC)
    found = sharding.shuffled(docs, 3)
    assert sorted(r.row.doc_id for r in found.collect()) == list(range(50))
    path = spark.conf.get("spark.checkpoint.dir") + "/shards"
    sharding.write(docs, path, 3)
    got = spark.read.parquet(path).collect()
    assert {r.doc_id: (r._shard, r._slot) for r in got} == {r.row.doc_id: (r.shard, r.slot) for r in found.collect()}
    assert {r.doc_id: r["row"] for r in got} == {k: str(k) for k in range(50)}
    with pytest.raises(ValueError):
        sharding.shuffled(docs, 0)
