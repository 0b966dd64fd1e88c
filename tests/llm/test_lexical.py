"""Ranked search against scoring every document, its SQL, and odd inputs."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from visitory.llm import lexical

DOC = "doc_id long, text string, term string, ids string, segment long"
ITEM = "item_id long, text string, term string, block long"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _terms(text):
    return TERM.findall((text or "").translate(FOLD))


def _plain(docs, items, k=20):
    """Every document scored for every item."""
    each = [(d, Counter(_terms(t))) for d, t in docs]
    n_docs, n_terms = sum(1 for _, c in each if c), sum(sum(c.values()) for _, c in each)
    df = Counter(t for _, c in each for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c in each:
            m = 75 + 25 * sum(c.values()) * n_docs // max(1, n_terms)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in _terms(text) if c[t])
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        found.sort()
        out += [(item, k + 1, f[3], -f[0]) for k, f in enumerate(found[:k])]
    return sorted(out, key=str)


def _corpus(seed, n):
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(300)] + ["Ärger", "ñandú", "日本語", "x" * 100, "A1"]
    weights = [1 / (k + 1) for k in range(len(words))]
    texts = [" ".join(rnd.choices(words, weights, k=rnd.choice([0, 1, 5, 30, 200]))) for _ in range(n)]
    texts += ["copy of W1 w2, w3"] * 60 + [None, "", "...", "w299 " * 5000, "y" * 3_000_000 + " w298"]
    docs = [(k if k % 50 else None, t) for k, t in enumerate(texts)] + [(7, "w1 w1"), (7, "w1 w1")]
    items = [(k, " ".join(rnd.choices(words, k=rnd.choice([1, 3, 12, 40])))) for k in range(25)]
    return docs, items + [(3, "w1 w2 w2"), (100, None), (101, ""), (102, "nowhere"), (None, "w5 ÄRGER"), (103, "copy w1"), (104, "y" * 3_000_000)]


def test_terms():
    text = "Ab_cÉ-9 日本 x\x00y z ſ"
    assert [t.decode() for some in lexical.terms(text.encode()) for t in some] == _terms(text)
    long = "ab " * 1_000_000 + "c" * 2_500_000 + " d"
    assert Counter(t for some in lexical.terms(long.encode()) for t in some) == Counter(t.encode() for t in _terms(long))


def test_numbers_round_trip():
    x = np.array([0, 1, 127, 128, 16383, 16384, 2_000_000, 1 << 28, (1 << 32) - 1])
    data, at = lexical._pack(x)
    assert (lexical._unpack(data) == x).all() and at[-1] == len(data)


@pytest.mark.parametrize(("seed", "partitions", "segment"), [(1, 1, 8 << 20), (2, 6, 3000)])
def test_equals_scoring_every_document(spark, monkeypatch, seed, partitions, segment):
    docs, items = _corpus(seed, 900)
    table = spark.createDataFrame([(*d, "t", "i", 1) for d in docs], DOC).repartition(partitions)
    asked = spark.createDataFrame([(*i, "t", 1) for i in items], ITEM)
    if partitions > 1:  # several shards and blocks of items
        monkeypatch.setattr(lexical, "SHARD_TERMS", 20_000)
        monkeypatch.setattr(lexical, "ITEMS", 10)
    made = lexical.written(lexical.index(table, segment_bytes=segment), "t")
    got = sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in lexical.ranked(asked, made).collect()), key=str)
    assert got == _plain(docs, items)


def test_bounds_hold_and_blocks_stay_closed():
    """A shard whose rare term decides: blocks of the common list are left unread, and results stay exact."""
    rnd = random.Random(9)
    texts = [" ".join(["common"] * rnd.randint(1, 2) + [f"u{rnd.randrange(5000)}" for _ in range(rnd.randint(3, 60))] + (["rare"] if 200 < k < 230 else [])) for k in range(20_000)]
    keys, count, rows, block_of, data, data_of, lengths = lexical._segment([t.encode() for t in texts])
    shard = lexical.Shard([(0, list(range(len(texts))), lengths)], len(texts), int(lengths.sum()))

    def a_list(term):
        k = keys.index(term)
        return lexical.List(shard, [(0, int(count[k]), rows[block_of[k] : block_of[k + 1]].tobytes(), data[data_of[k] : data_of[k + 1]].tobytes())], int(count[k]))

    common, rare = a_list(b"common"), a_list(b"rare")
    docs, scores = lexical.search(shard, [(common, 1), (rare, 1)])
    want = [(d, s) for _, _, d, s in _plain(list(enumerate(texts)), [(0, "common rare")])]
    assert sorted(zip(docs.tolist(), scores.tolist(), strict=True), key=str) == sorted(want, key=str)
    assert common.ready.mean() < 0.2
    for x in (common, rare):
        best = x.best.copy()
        x.read(np.arange(len(x.last)))
        for b in range(len(best)):
            assert best[b] >= x.parts[x.first[b] : x.first[b + 1]].max()


def test_large_counts():
    n = np.array([1, 10**9])
    assert lexical._lengths_to_m(n, 10**11, 10**14).tolist() == [75 + 25 * int(x) * 10**11 // 10**14 for x in n]


def test_empty(spark):
    docs, items = spark.createDataFrame([], DOC), spark.createDataFrame([(1, "a", "", 0)], ITEM)
    assert lexical.best(docs, items).count() == 0
    assert lexical.best(spark.createDataFrame([(1, "...", "", "", 0), (2, None, "", "", 0)], DOC), items).count() == 0
    some = spark.createDataFrame([(1, "a b", "", "", 0), (2, "c", "", "", 0)], DOC)
    assert lexical.best(some, spark.createDataFrame([], ITEM)).count() == 0
    assert [(r.item_id, r["rank"], r.doc_id) for r in lexical.best(some, items).collect()] == [(1, 1, 1)]


def test_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    for t in ("documents", "benchmark"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    got = lexical.best(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet"))
    assert sorted((r.item_id, r["rank"], r.doc_id, r.score) for r in got.collect()) == sorted(duck.execute(lexical.ORACLE_SQL).fetchall())
