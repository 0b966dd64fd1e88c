"""Vector codes against Lloyd's rounds without trees, and odd inputs."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from visitory.llm import codes

ROW = "vec_id long, embedding array<double>, label int, part string, code array<int>"


def _plain(vectors, ids):
    """Codes, errors and codebooks by comparing every part with every entry."""
    n, width = vectors.shape
    parts = vectors.reshape(n, codes.PARTS, -1)
    first = [int(np.flatnonzero(ids == i)[0]) for i in sorted(set(ids.tolist()))[: codes.ENTRIES]]
    books = parts[first].transpose(1, 0, 2).copy()
    near = None
    for k in range(codes.ROUNDS + 1):
        apart = parts[:, :, None] - books[None]
        far = (apart * apart).sum(-1)
        near = far.argmin(-1)
        if k < codes.ROUNDS:
            for p in range(codes.PARTS):
                for j in range(books.shape[1]):
                    inside = parts[near[:, p] == j, p]
                    if len(inside):
                        books[p, j] = inside.sum(0) // len(inside)
    return near, np.take_along_axis(far, near[..., None], 2).sum((1, 2)), books


def _vectors(n, width, seed):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(9, width))
    out = centres[rnd.integers(0, 9, n)] + 0.05 * rnd.normal(size=(n, width))
    out[: n // 4] = rnd.normal(size=(n // 4, width))
    out[n // 2 : n // 2 + n // 5] = out[0]  # a common vector
    return out


@pytest.mark.parametrize(("n", "width", "k"), [(1, 8, 1), (3, 16, 3), (200, 8, 16), (1024, 64, 16), (777, 24, 5)])
def test_a_block_equals_plain_distances(n, width, k):
    x = codes.integers(_vectors(n, width, n))
    block = codes.Block(x, codes.PARTS)
    read = codes.Block(x.astype(np.int32), codes.PARTS, block.trees())
    books = x[np.random.default_rng(1).integers(0, n, k)].reshape(k, codes.PARTS, -1).transpose(1, 0, 2).copy()  # some entries are equal
    parts = x.reshape(n, codes.PARTS, -1)
    far = ((parts[:, :, None] - books[None]) ** 2).sum(-1)
    near = far.argmin(-1)
    for b in (block, read):
        e = codes.Entries(books)
        sums, counts = np.zeros(books.shape, dtype=np.int64), np.zeros(books.shape[:2], dtype=np.int64)
        got, whole, pairs = b.assign(e, sums, counts)
        assert (got.T == near).all()
        assert (b.errors(e, got) == far.min(-1).sum(1)).all()
        for p in range(codes.PARTS):
            for j in range(k):
                inside = parts[near[:, p] == j, p]
                assert counts[p, j] == len(inside) and (sums[p, j] == inside.sum(0)).all()
    if n == 1024:
        assert whole > n * codes.PARTS // 5 and pairs < n * codes.PARTS * k // 4  # the common vector alone is a fifth


@pytest.mark.parametrize("partitions", [1, 5])
def test_equals_rounds_without_trees(spark, partitions):
    x = _vectors(1500, 32, 3)
    ids = np.random.default_rng(2).permutation(1500)
    rows = [(int(i), v.tolist(), int(i) % 3 or None, "p", [1]) for i, v in zip(ids, x, strict=True)]
    odd = [(5000, None, 1, "p", None), (5001, [None] * 32, 1, "p", None), (-1, [math.nan] * 32, 1, "p", None), (-2, [math.inf] + [0.0] * 31, 1, "p", None), (-3, [], 1, "p", None), (-4, [1.0] * 8, 1, "p", None)]
    got = {r.vec_id: r for r in codes.coded(spark.createDataFrame(rows + odd, ROW).repartition(partitions)).collect()}
    near, error, books = _plain(codes.integers(x), ids)
    assert len(got) == 1500
    by = {}
    for i, e in zip(ids, error, strict=True):
        by[int(i) % 3 or None] = by.get(int(i) % 3 or None, 0) + int(e)
    for k, i in enumerate(ids):
        r = got[int(i)]
        assert (r.code, r.error, r.label_error) == (bytes(near[k].tolist()).hex(), error[k], by[int(i) % 3 or None])
    assert {r.codebooks_sha256 for r in got.values()} == {hashlib.sha256(",".join(map(str, books.ravel())).encode()).hexdigest()}


def test_odd_tables(spark):
    assert codes.coded(spark.createDataFrame([], ROW)).count() == 0
    assert codes.coded(spark.createDataFrame([(1, None, 1, "", None)], ROW)).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    # repeated rows, null ids, a length that 8 does not divide, extreme values, no label
    rows = [(1, [0.5] * 11), (1, [0.5] * 11), (None, [0.25] * 11), (2, [-1e300] * 11)]
    got = codes.coded(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id or 0, r.code) for r in got) == [(0, "00" * 8), (1, "00" * 8), (1, "00" * 8), (2, "0101010101010000")]
    assert len({r.label_error for r in got}) == 1
    lone = codes.coded(spark.createDataFrame([(None, [0.5] * 8), (None, [0.75] * 8)], "vec_id long, embedding array<float>")).collect()
    assert sorted(r.code for r in lone) == ["00" * 8, "01" * 8] and {r.error for r in lone} == {0}


def test_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{sf}/embeddings.parquet')")
    want = {r[0]: r[1:] for r in duck.execute(codes.ORACLE_SQL).fetchall()}
    got = codes.coded(spark.read.parquet(f"{sf}/embeddings.parquet"))
    assert {r.vec_id: (r.code, r.error, r.label_error, r.codebooks_sha256) for r in got.collect()} == want
