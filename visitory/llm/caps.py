"""Near-duplicate vectors by spherical-cap filters.

Vectors are turned by a random rotation and cut into BLOCKS parts; each part has a code of random unit vectors, and a
filter direction is one code vector of each part side by side. A vector belongs to every filter whose score (the sum of
its parts' products) exceeds a bound; these are listed part by part, leaving out what cannot reach the bound any more.
The code grows with the cube root of the number of vectors, so a filter holds few unrelated vectors at any size, and
the bound is set so that a vector meets as many as listed_at gives: the larger the code, the smaller the share of their
filters that near vectors have in common, so the number grows with the table to keep the chance of a pair without any
equally small. A vector that meets fewer than half of it takes a lower bound of its own. Sharing one filter is enough.

Vectors of fewer than FEW dimensions, where random filters would be too wide, are listed in the cells of a grid that the ball
of half the largest distance around them touches: the middle of a near pair lies in a cell of both, so none is missed.

Vectors meet in the shuffle on filters twice. First they come alone, and a filter's members without a near one among the
others are left out, which are nearly all. Those that stay come again with the other filters in which they stayed: a pair
counts only in the first filter it shares, so no pair becomes a row and none is counted twice. A filter whose members
are those of an earlier one is left out, and filters with many members are dealt out in chunks that meet two by two.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, grouped, slices, written
from .jaccard import roots

BLOCKS = 3
#: Filters of each vector at 10,000 vectors or fewer; twice as many for every hundredfold table.
LISTED = 128
#: Filters for each vector, which keeps unrelated vectors apart.
SPARSE = 200
CHUNK = 1024
SEED = 11
#: Dimensions from which filters are used in place of cells.
FEW = 17
#: Members up to which the vectors of many filters are compared side by side.
SMALL = 32


def usable(vector: Column) -> Column:
    """Whether a vector has a direction: not null, not all zero, no null or non-finite component."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def listed_at(vectors: int) -> int:
    """The filters that each of ``vectors`` vectors should meet."""
    return int(np.ceil(LISTED * 2 ** (np.log10(max(vectors, 10_000) / 10_000) / 2)))


class Cells:
    """The cells of a grid for unit vectors of few dimensions. Cells are the wider the more dimensions there are, so that a
    vector touches about a hundred at most."""

    def __init__(self, dims: int, least: float) -> None:
        reach = float(np.sqrt(max(0.0, 2 - 2 * least)))
        self.half = reach / 2 + 1e-9
        self.most = int(2 ** (62 / dims))  # numbers of a cell in one direction that names have room for
        self.width = max(reach * (1.5 if dims <= 8 else 2 if dims <= 11 else 3), 2 * (1 + self.half) / (min(self.most, 64) - 2))

    def listed(self, units: np.ndarray) -> list[np.ndarray]:
        """The cells that come within half the largest distance of each row of ``units``: at most two a dimension."""
        low, high = (np.floor((units + 1 + self.half + x) / self.width).astype(np.int64) for x in (-self.half, self.half))
        out = []
        for a, b in zip(low, high, strict=True):
            names = np.zeros(1, np.int64)
            for x, y in zip(a, b, strict=True):
                names = (names[:, None] * self.most + np.arange(x, y + 1)).ravel()
            out.append(np.sort(names))
        return out


class Filters:
    """The filter directions for vectors of ``dims`` dimensions, the same in every task."""

    def __init__(self, dims: int, vectors: int) -> None:
        rng = np.random.default_rng([SEED, dims])
        self.code = max(32, int(np.ceil((SPARSE * vectors) ** (1 / BLOCKS))))
        self.turn = np.linalg.qr(rng.normal(size=(dims, dims)))[0]
        self.cuts = np.array_split(np.arange(dims), BLOCKS)
        self.words = []
        for cut in self.cuts:
            w = rng.normal(size=(self.code, len(cut)))
            self.words.append(w / np.linalg.norm(w, axis=1, keepdims=True) / np.sqrt(BLOCKS))
        # in few dimensions near vectors share a smaller part of their filters
        self.wanted = int(listed_at(vectors) * max(1.0, 32 / dims))
        tail = min(0.5, self.wanted / self.code**BLOCKS)
        self.bound = -NormalDist().inv_cdf(tail) / np.sqrt(dims) if tail < 0.5 else -1.0

    def _over(self, scores: list[np.ndarray], bound: float) -> np.ndarray:
        rest = np.cumsum([s.max() for s in scores[::-1]])[::-1]
        rest = np.append(rest[1:], 0.0)
        sums, names = np.zeros(1), np.zeros(1, np.int64)
        for s, most in zip(scores, rest, strict=True):
            near = np.flatnonzero(s >= bound - most - sums.max())
            grid = sums[:, None] + s[near]
            i, j = np.nonzero(grid >= bound - most)
            sums, names = grid[i, j], names[i] * self.code + near[j]
            if not len(sums):
                break
        return names

    def listed(self, units: np.ndarray) -> list[np.ndarray]:
        """The filters of each row of ``units`` (unit vectors)."""
        turned = units @ self.turn
        scores = [turned[:, cut] @ w.T for cut, w in zip(self.cuts, self.words, strict=True)]
        out = []
        for k in range(len(units)):
            own, bound = [s[k] for s in scores], self.bound
            names = self._over(own, bound)
            while len(names) < min(self.wanted // 2, self.code ** len(own)):
                bound -= 0.02
                names = self._over(own, bound)
            out.append(np.sort(names))
        return out


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of one length, without nulls, as rows."""
    return np.asarray(pc.list_flatten(column), dtype=np.float64).reshape(len(column), -1)


def units(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _staying(least: float):
    """Of rows (dims, filter, i, j, chunk, node, vector), sorted by the first four: those with a near one among the others of
    the same four, and of another chunk where there are two."""
    key = ("dims", "filter", "i", "j")
    least -= 1e-9  # what stays is decided again

    def near(t: pa.Table) -> np.ndarray:
        columns = np.stack([t[c].to_numpy() for c in key])
        starts = np.flatnonzero(np.append(True, (columns[:, 1:] != columns[:, :-1]).any(0)))
        size = np.diff(np.append(starts, t.num_rows))
        group = np.repeat(np.arange(len(starts)), size)
        left = np.repeat(starts + size, size) - np.arange(t.num_rows)  # rows of the group from here on
        chunk, apart = t["chunk"].to_numpy(), t["i"].to_numpy() != t["j"].to_numpy()
        unit = units(matrix(t["vector"]))
        stays = np.zeros(t.num_rows, bool)
        few = size[group] <= SMALL
        for d in range(1, SMALL):
            a = np.flatnonzero(few & (left > d))
            if not len(a):
                break
            a = a[~apart[a] | (chunk[a] != chunk[a + d])]
            a = a[np.einsum("ij,ij->i", unit[a], unit[a + d]) >= least]
            stays[a] = stays[a + d] = True
        for g in np.flatnonzero(size > SMALL):
            at = slice(starts[g], starts[g] + size[g])
            linked = unit[at] @ unit[at].T >= least
            np.fill_diagonal(linked, False)
            if apart[starts[g]]:
                linked &= chunk[at][:, None] != chunk[at][None, :]
            stays[at] = linked.any(1)
        return stays

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(t: pa.Table) -> Iterator[pa.RecordBatch]:
            for dims in pc.unique(t["dims"]).to_pylist():
                part = t.filter(pc.equal(t["dims"], dims)).combine_chunks()
                yield from part.filter(pa.array(near(part))).select([*key, "chunk", "node"]).to_batches()

        held: pa.Table | None = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            same = np.ones(t.num_rows, bool)
            for c in key:
                column = t[c].to_numpy()
                same &= column == column[-1]
            last = t.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0
            if last:
                yield from done(t.slice(0, last))
            held = t.slice(last)
        if held is not None:
            yield from done(held)

    return run


def _bucket(table: pa.Table, least: float) -> pa.RecordBatch | None:
    chunk = table["chunk"].to_numpy()
    if (chunk == chunk[0]).all() and table["i"][0].as_py() != table["j"][0].as_py():
        return None
    node, copies, here = table["node"].to_numpy(), table["copies"].to_numpy(), table["filter"][0].as_py()
    unit = units(matrix(table["vector"]))
    linked = unit @ unit.T >= least
    np.fill_diagonal(linked, False)
    if (chunk != chunk[0]).any():
        linked &= chunk[:, None] != chunk[None, :]
    if linked.any():
        # leave what an earlier filter has counted
        size = np.asarray(pc.list_value_length(table["filters"]))
        flat, owner = np.asarray(pc.list_flatten(table["filters"])), np.repeat(np.arange(len(size)), size)
        before = flat < here
        if before.any():
            names, column = np.unique(flat[before], return_inverse=True)
            holds = np.zeros((len(node), len(names)), np.float32)
            holds[owner[before], column] = 1
            linked &= (holds @ holds.T) == 0
    some = np.flatnonzero(linked.any(axis=1))
    if not len(some):
        return None
    order = np.argsort(node)
    smallest = np.empty(len(node), np.int64)
    smallest[order] = node[order][roots(linked[np.ix_(order, order)])]
    links = linked.astype(np.int64) @ copies
    return pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(links[some]), pa.array(smallest[some])], names=["node", "links", "root"])


def near_vectors(rows: DataFrame, least: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per row of ``rows``: vec_id, n_links (other rows with a cosine of at least ``least``), component_id (the smallest
    vec_id that links reach, itself included), kept (vec_id = component_id).

    Vectors that are null, zero or hold null or non-finite components link with nothing, as do vectors of different
    lengths with each other. Equal vectors are one node from the start. Rows that repeat a vec_id are rows of their own
    and link like others; a null vec_id takes no part and gives null component_id and kept. An empty table gives an
    empty result. Other columns are not read.
    """
    # floats stay floats while they move; all is worked out in doubles
    kind = "float" if rows.schema[vector_col].dataType.simpleString() == "array<float>" else "double"
    base = rows.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast(f"array<{kind}>").alias("vector"))
    fine = base.filter(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    fine = fine.withColumns({"h1": F.xxhash64("vector"), "h2": F.xxhash64(F.lit(1), "vector")})
    nodes = fine.groupBy("h1", "h2").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "vectors")
    counts = {r["dims"]: r["n"] for r in nodes.groupBy(F.size("vector").alias("dims")).agg(F.count("*").alias("n")).collect()}

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters: dict[int, Filters | Cells] = {}
        for b in slices(batches, "vector", 1 << 19):
            lengths = np.asarray(pc.list_value_length(b.column("vector")))
            for dims in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == dims)
                part = b.take(pa.array(at))
                if dims not in filters:
                    filters[dims] = Filters(dims, counts[dims]) if dims >= FEW else Cells(dims, least)
                lists = filters[dims].listed(units(matrix(part.column("vector"))))
                size = [len(x) for x in lists]
                yield pa.RecordBatch.from_pydict({"node": np.repeat(part.column("node").to_numpy(), size), "dims": np.full(sum(size), dims, np.int32), "filter": np.concatenate(lists)})

    listed = written(nodes.select("node", "vector").repartition(F.col("node")).mapInArrow(decode, "node long, dims int, filter long"), "filters")
    held = listed.groupBy("dims", "filter").agg(F.count("*").alias("n"), F.sum(F.hash("node").cast("long")).alias("s1"), F.bit_xor(F.xxhash64("node")).alias("s2"))
    held = held.filter("n > 1").groupBy("dims", "n", "s1", "s2").agg(F.min("filter").alias("filter"))
    members = written(listed.join(held.select("dims", "filter", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks")), ["dims", "filter"]), "members")
    dealt = members.join(nodes.select("node", "vector"), "node")
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select("dims", "filter", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "node", "vector")
    sorted_rows = dealt.repartition("dims", "filter", "i", "j").sortWithinPartitions("dims", "filter", "i", "j")
    stay = written(sorted_rows.mapInArrow(_staying(least), "dims int, filter long, i int, j int, chunk int, node long"), "near-members")
    lists = stay.select("node", "filter").distinct().groupBy("node").agg(F.collect_list("filter").alias("filters"))
    dealt = stay.join(nodes.select("node", "copies", "vector").join(lists, "node"), "node")
    # only earlier filters are asked for
    dealt = dealt.withColumn("filters", F.filter("filters", lambda x: x < F.col("filter")))
    found = written(grouped(dealt, ["dims", "filter", "i", "j"], lambda t: _bucket(t, least), "node long, links long, root long"), "near-vectors")

    labels = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), "vector-groups")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    linked = nodes.select("node", "first").join(labels, "node").join(links, "node")
    leaders = linked.groupBy("root").agg(F.min("first").alias("leader"))
    linked = linked.join(leaders, "root").select("node", "links", "leader")
    known = nodes.select("h1", "h2", "copies", "node", "first").join(linked, "node", "left")
    known = known.select("h1", "h2", "copies", F.coalesce("leader", "first").alias("component_id"), F.coalesce("links", F.lit(0)).alias("links"))
    out = fine.select("vec_id", "h1", "h2").join(known, ["h1", "h2"])
    out = out.select("vec_id", (F.col("links") + F.col("copies") - 1).alias("n_links"), "component_id")
    alone = base.filter(~(F.col("vec_id").isNotNull() & usable(F.col("vector"))))
    out = out.unionByName(alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
