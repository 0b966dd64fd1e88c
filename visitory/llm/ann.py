"""Nearest neighbours by collision counting on single projections.

Vectors are scaled to length 1 and projected on PROJECTIONS random directions; each projection is a sorted array. Around
a query's own projections windows open and grow step by step (virtual rehashing: a wider window is the narrower one and
what lies beside it, so nothing is counted twice). A vector in at least NEEDED of the windows is verified on the
original numbers. A query is done when its k-th nearest verified vector lies so close that all nearer ones must have
met the bound with high probability; the last window is the whole array, so every query ends with k vectors or all.

All rows are indexed, in blocks; each block of queries meets each block of rows in a task, and each pair of blocks hands
on k rows a query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .caps import matrix, units, usable
from .common import grouped, written

PROJECTIONS, NEEDED = 64, 34
#: Half widths of the windows: the first, the factor from one to the next, and how many before the whole array.
FIRST, FACTOR, STEPS = 0.08, 1.25, 14
#: A query is done when its k-th distance is at most this share of the half width.
SURE = 1.0
ROW_BLOCK, QUERY_BLOCK = 16_384, 256
SEED = 13


class Index:
    """Sorted projections of one block of unit vectors."""

    def __init__(self, unit: np.ndarray) -> None:
        dims = unit.shape[1]
        rng = np.random.default_rng([SEED, dims])
        # orthogonal directions, as many as fit, tell more than independent ones
        turns = [np.linalg.qr(rng.normal(size=(dims, dims)))[0] * np.sqrt(dims) for _ in range(-(-PROJECTIONS // dims))]
        self.lines = np.concatenate(turns, axis=1)[:, :PROJECTIONS]
        self.unit = unit
        values = (unit @ self.lines).T
        self.order = np.argsort(values, axis=1).astype(np.int32)
        self.values = np.take_along_axis(values, self.order.astype(np.int64), axis=1)

    def nearest(self, queries: np.ndarray, own: list[np.ndarray], k: int) -> list[np.ndarray]:
        """The numbers of the verified vectors among which each query's k nearest are; ``own`` are left out."""
        n = len(self.unit)
        at = (queries @ self.lines).T
        widths = [*(FIRST * FACTOR**i for i in range(STEPS)), np.inf]
        low = np.empty((len(widths), *at.shape), np.int64)
        high = np.empty_like(low)
        for p in range(PROJECTIONS):
            for s, w in enumerate(widths):
                low[s, p] = np.searchsorted(self.values[p], at[p] - w, "left")
                high[s, p] = np.searchsorted(self.values[p], at[p] + w, "right")
        flat = self.order.ravel()
        base = np.arange(PROJECTIONS) * n
        out = []
        for q in range(len(queries)):
            count = np.zeros(n, np.int64)
            mine = np.zeros(n, bool)
            mine[own[q]] = True
            mid = (low[0, :, q] + high[0, :, q]) // 2
            left = right = mid
            verified = np.zeros(0, np.int64)
            for s, w in enumerate(widths):
                a, b = low[s, :, q], high[s, :, q]
                starts, ends = np.concatenate([base + a, base + right]), np.concatenate([base + left, base + b])
                size = np.maximum(ends - starts, 0)
                left, right = np.minimum(a, left), np.maximum(b, right)
                if total := int(size.sum()):
                    first = np.repeat(starts - (np.cumsum(size) - size), size)
                    count += np.bincount(flat[first + np.arange(total)], minlength=n)
                verified = np.flatnonzero((count >= NEEDED) & ~mine)
                if len(verified) >= k:
                    cosine = self.unit[verified] @ queries[q]
                    kth = np.partition(cosine, len(cosine) - k)[len(cosine) - k]
                    if np.sqrt(max(0.0, 2 - 2 * kth)) <= SURE * w:
                        verified = verified[cosine >= kth - 1e-9]
                        break
            out.append(verified)
        return out


def _meet(table: pa.Table, k: int) -> pa.RecordBatch | None:
    asked = table["asked"].to_numpy(zero_copy_only=False)
    ids = table["id"].to_numpy()
    if asked.all() or not asked.any():
        return None
    vectors = matrix(table["vector"])
    rows, queries = vectors[~asked], vectors[asked]
    row_ids, query_ids = ids[~asked], ids[asked]
    unit = units(rows)
    length = np.sqrt((rows * rows).sum(axis=1))
    order = np.argsort(row_ids, kind="stable")
    first, last = np.searchsorted(row_ids[order], query_ids, "left"), np.searchsorted(row_ids[order], query_ids, "right")
    found = Index(unit).nearest(units(queries), [order[a:b] for a, b in zip(first, last, strict=True)], k)
    out_q, out_r, out_s = [], [], []
    for q, near in enumerate(found):
        # row by row, so that equal vectors get equal numbers
        score = (rows[near] * queries[q]).sum(axis=1) / (length[near] * np.sqrt((queries[q] * queries[q]).sum()))
        best = np.lexsort((row_ids[near], -score))[:k]
        out_q += [query_ids[q]] * len(best)
        out_r += row_ids[near][best].tolist()
        out_s += score[best].tolist()
    return pa.RecordBatch.from_arrays([pa.array(out_q, pa.int64()), pa.array(out_r, pa.int64()), pa.array(out_s, pa.float64())], names=["query_id", "vec_id", "score"])


def nearest(rows: DataFrame, asked: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each row of ``rows`` where ``asked`` holds, its ``k`` nearest other rows by cosine: query_id, rank (from 1),
    vec_id, score, nearest first and ties to the smaller vec_id; all candidates if there are fewer.

    Vectors that are null, zero or hold null or non-finite components take no part, nor do null ids; vectors of different
    lengths do not meet. Rows that repeat a vec_id count once, with the nearest of their vectors; a query's own vec_id is
    no candidate. An empty table gives an empty result. Other columns are not read.
    """
    base = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), F.coalesce(asked, F.lit(False)).alias("asked"))
    base = base.filter(F.col("id").isNotNull() & usable(F.col("vector"))).withColumn("dims", F.size("vector"))
    size = base.agg(F.count("*").alias("rows"), F.count_if("asked").alias("queries")).first()
    row_blocks, query_blocks = -(-size["rows"] // ROW_BLOCK) or 1, -(-size["queries"] // QUERY_BLOCK) or 1
    block = F.xxhash64("id")
    indexed = base.select("dims", "id", "vector", F.lit(False).alias("asked"), F.pmod(block, F.lit(row_blocks).cast("long")).alias("row_block"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(query_blocks - 1).cast("long"))).alias("query_block"))
    queries = base.filter("asked").dropDuplicates(["id"])
    queries = queries.select("dims", "id", "vector", "asked", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(row_blocks - 1).cast("long"))).alias("row_block"), F.pmod(block, F.lit(query_blocks).cast("long")).alias("query_block"))
    met = grouped(indexed.unionByName(queries), ["dims", "row_block", "query_block"], lambda t: _meet(t, k), "query_id long, vec_id long, score double")
    best = written(met, "neighbours").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
