"""Vector codes: a codebook of 16 entries for each of 8 parts of a vector, refined by Lloyd's rounds on two trees.

Components become integers, so every sum, distance and tie is exact and does not depend on how rows are dealt.

* Vectors are gathered in blocks of up to ``BLOCK`` rows. For each part a block gets a balanced tree over its parts:
  every node has its bounding box, the sum of its parts and their number. The trees are built once and written.
* A round sends the codebooks (``PARTS`` x ``ENTRIES`` entries, whatever the corpus) to the tasks. They are a tree as
  well. Both trees are gone down together: for a node of parts and a node of entries the boxes bound the distance from
  below and above, and an entry node that is farther than the best upper bound is pruned with all its entries. At single
  entries the difference of two distances, which is linear, is bounded over the box as well. A node left with one entry
  takes it as a whole, by its cached sum. Parts of leaves left with more are compared one by one.
* A task hands on one sum for each entry and component; Spark adds these up and the driver divides them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Vectors in a block, and parts in a leaf.
BLOCK, LEAF = 1024, 16
#: Scaled components are held within this, so that sums and squares stay within 64 bits.
MOST = 1 << 26
_FAR = np.iinfo(np.int64).max


def _depth(n: int, leaf: int) -> int:
    return (max(1, -(-n // leaf)) - 1).bit_length()


def _sorted_tree(points: np.ndarray, depth: int) -> np.ndarray:
    """The order of the rows of ``points`` (parts, n, d) in a balanced tree for each part: every node is split in the
    middle of its widest direction. Rows beyond n, which even the leaves out, are numbered from n on."""
    parts, n, _ = points.shape
    padded = -(-n // (1 << depth)) << depth
    at = np.broadcast_to(np.arange(padded), (parts, padded)).copy()
    which = np.arange(parts)[:, None, None]
    for level in range(depth):
        rows = at.reshape(parts, 1 << level, -1)
        inside = points[which, np.minimum(rows, n - 1)]
        widest = (inside.max(2) - inside.min(2)).argmax(-1)
        values = np.take_along_axis(inside, widest[:, :, None, None], 3)[..., 0]
        at = np.take_along_axis(rows, values.argsort(2, kind="stable"), 2).reshape(parts, padded)
    return at


def _boxes(leaves: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Lower and upper corners of all nodes by level, root first; ``leaves`` is (parts, leaves, rows, d)."""
    low, high = [leaves.min(2)], [leaves.max(2)]
    while low[0].shape[1] > 1:
        low.insert(0, np.minimum(low[0][:, ::2], low[0][:, 1::2]))
        high.insert(0, np.maximum(high[0][:, ::2], high[0][:, 1::2]))
    return low, high


def _added(leaves: np.ndarray) -> list[np.ndarray]:
    out = [leaves]
    while out[0].shape[1] > 1:
        out.insert(0, out[0][:, ::2] + out[0][:, 1::2])
    return out


class Entries:
    """The codebooks (parts, entries, d) with their trees. Of equal entries only the lowest is ever chosen."""

    def __init__(self, books: np.ndarray):
        parts, k, d = books.shape
        self.books, self.depth = books, _depth(k, 1)
        self.order = np.minimum(at := _sorted_tree(books, self.depth), k - 1)
        same = (books[:, :, None] == books[:, None, :]).all(-1) & np.tri(k, k, -1, dtype=bool)
        alive = np.take_along_axis(~same.any(2), self.order, 1) & (at < k)
        leaves = np.take_along_axis(books, self.order[:, :, None], 1)
        self.low, self.high = _boxes(leaves[:, :, None])
        self.alive = [alive.reshape(parts, 1 << level, -1).any(2) for level in range(self.depth + 1)]


class Block:
    """Up to ``BLOCK`` vectors (n, parts * d) of integers, with the tree of each part."""

    def __init__(self, vectors: np.ndarray, parts: int, trees: dict[str, np.ndarray] | None = None):
        n = len(vectors)
        self.n, self.parts, self.depth = n, parts, _depth(n, LEAF)
        points = vectors.reshape(n, parts, -1).transpose(1, 0, 2)
        self.d = points.shape[2]
        self.at = _sorted_tree(points, self.depth) if trees is None else trees["at"].reshape(parts, -1)
        self.points = np.take_along_axis(points, np.minimum(self.at, n - 1)[:, :, None], 1)
        self.real = self.at < n
        if trees is None:
            leaves = self.points.reshape(parts, 1 << self.depth, -1, self.d)
            real = self.real.reshape(parts, 1 << self.depth, -1)
            self.low, self.high = _boxes(leaves)
            self.total, self.count = _added((leaves * real[..., None]).sum(2)), _added(real.sum(2))
        else:
            for name in ("low", "high", "total", "count"):
                flat = trees[name].reshape(parts, (2 << self.depth) - 1, -1)
                made = [flat[:, (1 << k) - 1 : (2 << k) - 1] for k in range(self.depth + 1)]
                setattr(self, name, [x[..., 0] for x in made] if name == "count" else made)

    def trees(self) -> dict[str, np.ndarray]:
        out = {"at": self.at.astype(np.int32)}
        for name, kind in (("low", np.int32), ("high", np.int32), ("total", np.int64), ("count", np.int32)):
            out[name] = np.concatenate(getattr(self, name), axis=1).astype(kind)
        return out

    def assign(self, e: Entries, sums: np.ndarray | None = None, counts: np.ndarray | None = None) -> tuple[np.ndarray, int, int]:
        """The entry of every part (parts, n), how many parts were assigned by whole nodes, and how many node pairs
        were looked at. Adds to ``sums`` (parts, entries, d) and ``counts`` (parts, entries) if given."""
        codes = np.zeros(self.at.shape, dtype=np.int64)
        part, node = np.arange(self.parts), np.zeros(self.parts, dtype=np.int64)
        fit = e.alive[0].copy()
        whole = pairs = 0
        for level in range(self.depth + 1):
            deep = min(level, e.depth)
            if level == self.depth:  # a shallow tree of parts meets the entries themselves at its leaves
                fit = np.repeat(fit, 1 << (e.depth - deep), axis=1) & e.alive[e.depth][part]
                deep = e.depth
            pairs += int(fit.sum())
            low, high = self.low[level][part, node][:, None].astype(np.int64), self.high[level][part, node][:, None].astype(np.int64)
            e_low, e_high = e.low[deep][part], e.high[deep][part]
            gap = np.maximum(np.maximum(low - e_high, e_low - high), 0)
            reach = np.maximum(high - e_low, e_high - low)
            nearest, farthest = (gap * gap).sum(-1), (reach * reach).sum(-1)
            fit &= nearest <= np.where(fit, farthest, _FAR).min(1)[:, None]
            if deep == e.depth:
                # boxes of entries are points now: an entry is out where the one of the best bound is nearer all over the box
                best = np.where(fit, farthest, _FAR).argmin(1)
                f = np.take_along_axis(e_low, best[:, None, None], 1)
                slope = 2 * (e_low - f)
                fit &= (f * f - e_low * e_low + np.maximum(slope * low, slope * high)).sum(-1) >= 0
                sure = fit.sum(1) == 1
                p, q = part[sure], node[sure]
                entry = e.order[p, fit[sure].argmax(1)]
                codes.reshape(self.parts, 1 << level, -1)[p, q] = entry[:, None]
                whole += int(self.count[level][p, q].sum())
                if sums is not None:
                    np.add.at(sums, (p, entry), self.total[level][p, q])
                    np.add.at(counts, (p, entry), self.count[level][p, q])
                part, node, fit = part[~sure], node[~sure], fit[~sure]
            if not len(part):
                break
            if level < self.depth:
                part, node = np.repeat(part, 2), (2 * node[:, None] + np.arange(2)).ravel()
                fit = np.repeat(fit, 2, axis=0)
                if deep < e.depth:
                    fit = np.repeat(fit, 2, axis=1) & e.alive[deep + 1][part]
        if len(part):
            self._leaves(e, part, node, fit, codes, sums, counts)
        out = np.empty((self.parts, self.n), dtype=np.int64)
        p, q = np.nonzero(self.real)
        out[p, self.at[p, q]] = codes[p, q]
        return out, whole, pairs

    def _leaves(self, e: Entries, part, node, fit, codes, sums, counts) -> None:
        k = e.books.shape[1]
        open_ = np.zeros((len(part), k), dtype=bool)
        rows, leaf = np.nonzero(fit)
        open_[rows, e.order[part[rows], leaf]] = True
        shape = (self.parts, 1 << self.depth, -1)
        x = self.points.reshape(*shape, self.d)[part, node].astype(np.int64)
        far = np.full((*x.shape[:2], k), _FAR)
        for j in range(k):  # one entry at a time keeps the memory at one number for each part and entry
            rows = np.nonzero(open_[:, j])[0]
            if len(rows):
                apart = x[rows] - e.books[part[rows], j][:, None]
                far[rows, :, j] = (apart * apart).sum(-1)
        entry = far.argmin(-1)
        codes.reshape(shape)[part, node] = entry
        if sums is not None:
            real = self.real.reshape(shape)[part, node]
            key = (part[:, None] * k + entry)[real]
            counts += np.bincount(key, minlength=self.parts * k).reshape(self.parts, k)
            inside = x[real]
            for j in range(self.d):  # exact: sums of a block are far below 2^53
                sums[:, :, j] += np.bincount(key, weights=inside[:, j], minlength=self.parts * k).astype(np.int64).reshape(self.parts, k)

    def errors(self, e: Entries, codes: np.ndarray) -> np.ndarray:
        """The squared distances of each vector to its entries, summed over parts."""
        out = np.zeros(self.n, dtype=np.int64)
        for p in range(self.parts):
            x = np.empty((self.n, self.d), dtype=np.int64)
            x[self.at[p][self.real[p]]] = self.points[p][self.real[p]]
            apart = x - e.books[p][codes[p]]
            out += (apart * apart).sum(1)
        return out


def integers(values: np.ndarray) -> np.ndarray:
    """floor(4096 x), within ``MOST``."""
    return np.clip(np.floor(values.astype(np.float64) * SCALE), -MOST, MOST).astype(np.int64)


def _width(length: int) -> int:
    return -(-length // PARTS) * PARTS


def _matrix(values: pa.Array, n: int, length: int) -> np.ndarray:
    out = np.zeros((n, _width(length)), dtype=np.int64)
    out[:, :length] = integers(values.to_numpy(zero_copy_only=False).reshape(n, length))
    return out


def blocks(rows: DataFrame, length: int) -> DataFrame:
    """Blocks of ``rows`` (vec_id, label, vector of ``length`` doubles) with their trees, one row each."""
    kind = rows.schema["vec_id"].dataType.simpleString()
    names = ("at", "low", "high", "total", "count")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(table: pa.Table) -> pa.RecordBatch:
            b = table.combine_chunks()
            vectors = _matrix(b.column("vector").chunk(0).flatten(), b.num_rows, length)
            trees = Block(vectors, PARTS).trees()
            ends = pa.array([0, b.num_rows], pa.int32())
            lists = [pa.ListArray.from_arrays(ends, b.column(c).chunk(0)) for c in ("vec_id", "label")]
            blobs = [vectors.astype(np.int32), *(trees[c] for c in names)]
            return pa.RecordBatch.from_arrays([*lists, *(pa.array([x.tobytes()], pa.binary()) for x in blobs)], names=["vec_id", "label", "vectors", *names])

        held: list[pa.RecordBatch] = []
        n = 0
        for b in batches:
            at = 0
            while at < b.num_rows:
                step = min(BLOCK - n, b.num_rows - at)
                held.append(b.slice(at, step))
                at, n = at + step, n + step
                if n == BLOCK:
                    yield made(pa.Table.from_batches(held))
                    held, n = [], 0
        if held:
            yield made(pa.Table.from_batches(held))

    return rows.mapInArrow(run, f"vec_id array<{kind}>, label array<string>, vectors binary, " + ", ".join(f"{c} binary" for c in names))


def _read(b: pa.RecordBatch, row: int, width: int) -> Block:
    kinds = {"at": np.int32, "low": np.int32, "high": np.int32, "total": np.int64, "count": np.int32}
    trees = {c: np.frombuffer(b.column(c)[row].as_buffer(), kind) for c, kind in kinds.items()}
    return Block(np.frombuffer(b.column("vectors")[row].as_buffer(), np.int32).reshape(-1, width), PARTS, trees)


def _round(made: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round."""
    parts, k, d = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = Entries(books)
        sums, counts = np.zeros((parts, k, d), dtype=np.int64), np.zeros((parts, k), dtype=np.int64)
        for b in slices(batches, "vectors"):
            for row in range(b.num_rows):
                _read(b, row, parts * d).assign(e, sums, counts)
        p, j = np.nonzero(counts)
        if len(p):
            cells = [np.repeat(x, d) for x in (p, j)] + [np.tile(np.arange(d), len(p)), sums[p, j].ravel(), np.repeat(counts[p, j], d)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cells], names=["part", "entry", "place", "total", "n"])

    found = made.mapInArrow(run, "part long, entry long, place long, total long, n long").groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    after = books.copy()
    for r in found.collect():  # parts x entries x places rows at most
        after[r["part"], r["entry"], r["place"]] = r["total"] // r["n"]
    return after


def _coded(made: DataFrame, books: np.ndarray, kind: str) -> DataFrame:
    parts, _, d = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = Entries(books)
        for b in slices(batches, "vectors"):
            for row in range(b.num_rows):
                block = _read(b, row, parts * d)
                codes, _, _ = block.assign(e)
                text = codes.T.astype(np.uint8).tobytes().hex()
                step = 2 * parts
                yield pa.RecordBatch.from_arrays(
                    [b.column("vec_id")[row].values, b.column("label")[row].values, pa.array([text[i : i + step] for i in range(0, len(text), step)], pa.string()), pa.array(block.errors(e, codes), pa.int64())],
                    names=["vec_id", "label", "code", "error"],
                )

    return made.mapInArrow(run, f"vec_id {kind}, label string, code string, error long")


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and place."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error) of every vector, and the final codebooks (parts, entries, components).

    Vectors that are null or empty or hold null or non-finite components are dropped, as are those whose length is not
    the table's most frequent one (the longer of two). A length that 8 does not divide is filled up with zeros. Codebooks
    start from the vectors of the 16 smallest ids that are not null; of rows that repeat an id the smallest vector
    counts here, and all are coded. Fewer ids give fewer entries. With ids all null, the 16 smallest vectors start.
    Components of more than 16,384 are taken as 16,384. Labels are compared as text; without such a column all are null.
    An empty table gives an empty result and no codebooks.
    """
    x = F.col(vector_col).cast("array<double>")
    label = F.col(label_col).cast("string") if label_col in rows.columns else F.lit(None).cast("string")
    kept = rows.select(F.col(id_col).alias("vec_id"), label.alias("label"), x.alias("vector"))
    finite = F.forall("vector", lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    kept = kept.filter(F.col("vector").isNotNull() & (F.size("vector") > 0) & finite)
    kind = kept.schema["vec_id"].dataType.simpleString()
    usual = kept.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if usual is None:
        return rows.sparkSession.createDataFrame([], f"vec_id {kind}, label string, code string, error long"), np.zeros((PARTS, 0, 0), dtype=np.int64)
    length = usual["n"]
    kept = kept.filter(F.size("vector") == length)
    ids = [r[0] for r in kept.filter("vec_id is not null").select("vec_id").distinct().orderBy("vec_id").limit(ENTRIES).collect()]
    first = kept.filter(F.col("vec_id").isin(ids)).groupBy("vec_id").agg(F.min("vector").alias("vector")).orderBy("vec_id").limit(ENTRIES).collect()
    first = first or kept.orderBy("vector").limit(ENTRIES).collect()
    starts = _matrix(pa.array([v for r in first for v in r["vector"]], pa.float64()), len(first), length)
    books = np.ascontiguousarray(starts.reshape(len(first), PARTS, -1).transpose(1, 0, 2))
    made = written(blocks(kept, length), "vector-trees")
    for _ in range(rounds):
        books = _round(made, books)
    return _coded(made, books, kind), books


def coded(rows: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every vector; see :func:`compress`."""
    found, books = compress(rows)
    found = written(found, "vector-codes")
    # sums are combined before they move; a label of a third of all rows is one row here
    by_label = found.groupBy("label").agg(F.sum("error").alias("label_error"))
    both = found.alias("v").join(by_label.alias("s"), F.col("v.label").eqNullSafe(F.col("s.label")))
    return both.select("v.vec_id", "v.code", "v.error", "s.label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _oracle() -> str:
    steps = [
        f"""kept AS MATERIALIZED (SELECT vec_id, label, embedding, len(embedding) // {PARTS} AS d FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""comp AS MATERIALIZED (SELECT vec_id, (i - 1) // d AS part, (i - 1) % d AS pos, CAST(floor({SCALE} * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS v
  FROM (SELECT vec_id, embedding, d, unnest(range(1, len(embedding) + 1)) AS i FROM kept))""",
        f"seeds AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT {ENTRIES})",
        "book0 AS MATERIALIZED (SELECT part, entry, pos, v FROM comp JOIN seeds USING (vec_id))",
    ]
    for k in range(ROUNDS + 1):
        steps.append(
            f"""near{k} AS MATERIALIZED (SELECT vec_id, part, min(d * {ENTRIES} + entry) AS best FROM (
  SELECT c.vec_id, c.part, b.entry, CAST(sum((c.v - b.v) * (c.v - b.v)) AS BIGINT) AS d FROM comp c JOIN book{k} b ON c.part = b.part AND c.pos = b.pos GROUP BY ALL) GROUP BY ALL)"""
        )
        if k < ROUNDS:
            steps.append(
                f"""book{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, b.pos, coalesce(CAST(floor(CAST(m.s AS DOUBLE) / m.n) AS BIGINT), b.v) AS v FROM book{k} b LEFT JOIN (
  SELECT c.part, n.best % {ENTRIES} AS entry, c.pos, sum(c.v) AS s, count(*) AS n FROM comp c JOIN near{k} n ON n.vec_id = c.vec_id AND n.part = c.part GROUP BY ALL) m
  ON m.part = b.part AND m.entry = b.entry AND m.pos = b.pos)"""
            )
    steps.append(
        f"""codes AS (SELECT vec_id, string_agg(printf('%02x', best % {ENTRIES}), '' ORDER BY part) AS code, CAST(sum(best // {ENTRIES}) AS BIGINT) AS error FROM near{ROUNDS} GROUP BY vec_id)"""
    )
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM book{ROUNDS}) AS codebooks_sha256
FROM codes JOIN kept USING (vec_id)"""


ORACLE_SQL = _oracle()
