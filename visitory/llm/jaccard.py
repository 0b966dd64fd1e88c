"""Near-duplicate join of documents on word n-grams: MinHash banding, then exact verification.

A document is the set of its runs of five words (lower case, letters, digits and underscores; a text of fewer words is
one run). BANDS bands of ROWS minima each find a pair of similarity s with probability 1 - (1 - s**ROWS)**BANDS, which
is 0.9999 at 0.8. Documents meet in the shuffle on band hashes; a bucket whose members all meet in an earlier bucket is
left out, and a pair is verified on the full sets in the first band that it shares, so it counts once.

No pair becomes a row. Equal texts are one node from the start. The sets of a bucket are compared inside a task, in
chunks of bounded size (a bucket of more chunks meets chunk by chunk), and each task hands on a number of links and a
local root per document. Counting columns that nearly all members share by who lacks them keeps groups of thousands of
near copies cheap.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, grouped, slices, written

WORDS, LEAST = 5, 0.8
BANDS, ROWS = 24, 5
#: Bounds of a chunk of a bucket: documents, n-grams.
CHUNK_DOCS, CHUNK_GRAMS = 512, 500_000
_WORD = re.compile(r"\w+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    """Words to 64-bit hashes; starts anew when it has grown large, and after each task."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _Hashes()


def grams(texts: list[str | None], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram hashes of all texts, one after the other, with the number of each text; repeats stay."""
    found = [_WORD.findall(t.lower()) if t else [] for t in texts]
    size = np.fromiter(map(len, found), np.int64, len(found))
    flat = np.fromiter((_hashes[w] for ws in found for w in ws), np.uint64, int(size.sum()))
    short = size < words
    count = np.where(short, size > 0, size - words + 1)
    start = np.cumsum(size) - size
    first = np.repeat(start - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    used = np.minimum(size, words)
    left = np.repeat(used, count)
    h = left.astype(np.uint64)
    with np.errstate(over="ignore"):
        for k in range(words):
            here = np.where(k < left, flat[np.minimum(first + k, max(0, len(flat) - 1))] if len(flat) else h, np.uint64(0))
            h = (h * np.uint64(0xC2B2AE3D27D4EB4F)) ^ here
            h ^= h >> np.uint64(31)
        h *= _MIX
        h ^= h >> np.uint64(32)
    return h, count


def bands(texts: list[str | None], n_bands: int = BANDS, rows: int = ROWS, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(texts x bands) hashes and the number of n-grams of each text."""
    h, count = grams(texts, words)
    out = np.zeros((len(texts), n_bands), np.uint64)
    some = np.flatnonzero(count)
    if len(some):
        starts = (np.cumsum(count) - count)[some]
        rng = np.random.default_rng(20)
        with np.errstate(over="ignore"):
            for b in range(n_bands):
                key = np.full(len(some), np.uint64(b + 1))
                for _ in range(rows):
                    a, c = rng.integers(1, 2**63, 2, dtype=np.uint64)
                    key = (key ^ np.minimum.reduceat(h * (a | np.uint64(1)) + c, starts)) * _MIX
                    key ^= key >> np.uint64(29)
                out[some, b] = key
    return out, count


def _local_links(sets: list[np.ndarray], ask: np.ndarray, least: float) -> np.ndarray:
    """Which of the asked pairs (a symmetric truth table) have a Jaccard similarity of at least ``least``."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    asked = np.argwhere(np.triu(ask, 1))
    linked = np.zeros((n, n), bool)
    if len(asked) <= 4 * n:
        for i, j in asked:
            small, large = size[i], size[j]
            if min(small, large) < least * max(small, large) - 1e-9:
                continue
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            linked[i, j] = linked[j, i] = both >= least * (small + large - both) - 1e-9
        return linked
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(column, kind="stable")
    holder = np.repeat(np.arange(n), size)[order]
    cuts = np.flatnonzero(np.diff(column[order])) + 1
    both, lacks, base = np.zeros((n, n), np.int32), np.zeros(n, np.int32), 0
    everyone = np.ones(n, bool)
    for held in np.split(holder, cuts):
        if len(held) < 2:
            continue
        if 2 * len(held) > n:
            base += 1
            everyone[held] = False
            held = np.flatnonzero(everyone)
            everyone[:] = True
            lacks[held] += 1
        if len(held):
            both[np.ix_(held, held)] += 1
    both += base - lacks[:, None] - lacks[None, :]
    linked = ask & (both >= least * (size[:, None] + size[None, :] - both) - 1e-9)
    np.fill_diagonal(linked, False)
    return linked


def roots(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric truth table, the smallest row that links reach."""
    n = len(linked)
    root = np.arange(n)
    pairs = np.argwhere(linked)
    while len(pairs):
        near = root.copy()
        np.minimum.at(near, pairs[:, 0], root[pairs[:, 1]])
        near = near[near]
        if (near == root).all():
            break
        root = near
    return root


def _bucket(table: pa.Table, least: float) -> pa.RecordBatch | None:
    """The links that are first found in one bucket, or between two of its chunks."""
    row = table["node"].to_numpy()
    copies = table["copies"].to_numpy()
    keys = np.stack([np.frombuffer(b, np.uint64) for b in table["bands"].to_pylist()])
    band, chunk = table["band"][0].as_py(), table["chunk"].to_numpy()
    ask = np.ones((len(row), len(row)), bool)
    if (chunk != chunk[0]).any():
        ask &= chunk[:, None] != chunk[None, :]
    elif table["i"][0].as_py() != table["j"][0].as_py():
        return None
    for b in range(band):
        ask &= keys[:, b][:, None] != keys[:, b][None, :]
    if not ask.any():
        return None
    sets = [np.frombuffer(s, np.uint64) for s in table["grams"].to_pylist()]
    linked = _local_links(sets, ask, least)
    some = np.flatnonzero(linked.any(axis=1))
    if not len(some):
        return None
    order = np.argsort(row)
    smallest = np.empty(len(row), np.int64)
    smallest[order] = row[order][roots(linked[np.ix_(order, order)])]
    links = linked.astype(np.int64) @ copies
    return pa.RecordBatch.from_arrays([pa.array(row[some]), pa.array(links[some]), pa.array(smallest[some])], names=["node", "links", "root"])


def text_key(text: Column) -> list[Column]:
    """t1 and t2: 128 bits that stand for a text."""
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]


def near_duplicates(docs: DataFrame, least: float = LEAST, words: int = WORDS, n_bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text", keys: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, class_id (the smallest doc_id that links reach, itself included), n_links (other
    rows whose text is the same or has a similarity of at least ``least``), kept (true for one row of each class).

    Null and empty texts link with nothing, and texts without any word only with their exact copies. Rows that repeat
    a doc_id are rows of their own; rows with a null doc_id link with nothing, have a null class_id and are kept.
    An empty table gives an empty result. Other columns are not read. With ``keys`` the columns t1 and t2 of
    :func:`text_key` follow.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()
    base = base.select("doc_id", "text", *text_key(F.col("text")))
    more = ["t1", "t2"] if keys else []

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 1 << 19):
            keys, count = bands(b.column("text").to_pylist(), n_bands, rows, words)
            packed = [k.tobytes() if c else None for k, c in zip(keys, count, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("t1"), b.column("t2"), pa.array(packed, pa.binary()), pa.array(count, pa.int64())], names=["doc_id", "t1", "t2", "bands", "n_grams"])
        _hashes.clear()  # workers live on for other operators

    with_text = base.filter("doc_id is not null and text <> ''")
    signed = with_text.mapInArrow(sign, f"doc_id {kind}, t1 long, t2 long, bands binary, n_grams long")
    signed = written(signed.withColumn("row", F.monotonically_increasing_id()), "signatures")
    first = F.min(F.struct("doc_id", "row"))
    nodes = signed.groupBy("t1", "t2").agg(F.count("*").alias("copies"), first.alias("first"), F.first("bands").alias("bands"), F.first("n_grams").alias("n_grams"))
    nodes = written(nodes.withColumn("node", F.col("first.row")), "texts")

    # band keys: eight bytes each of the binary, cut out natively
    spread = nodes.filter("bands is not null").select("node", "n_grams", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(n_bands - 1)), lambda k: F.substring("bands", k * 8 + 1, F.lit(8)))).alias("band", "key"))
    spread = spread.select("node", "n_grams", "band", F.xxhash64("band", "key").alias("bucket"))
    held = spread.groupBy("bucket", "band").agg(F.count("*").alias("n"), F.sum("n_grams").alias("grams"), F.sum(F.hash("node").cast("long")).alias("s1"), F.bit_xor(F.xxhash64("node")).alias("s2"))
    # of buckets with the same members the earliest band stays
    held = held.filter("n > 1").groupBy("n", "grams", "s1", "s2").agg(F.min(F.struct("band", "bucket")).alias("b")).select("b.bucket", "n", "grams")
    chunks = F.ceil(F.greatest(F.col("n") / CHUNK_DOCS, F.col("grams") / CHUNK_GRAMS)).cast("int")
    members = written(spread.select("node", "band", "bucket").join(held.select("bucket", chunks.alias("chunks")), "bucket"), "buckets")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 1 << 19):
            h, count = grams(b.column("text").to_pylist(), words)
            ends = np.cumsum(count)
            sets = [np.unique(h[e - c : e]).tobytes() for e, c in zip(ends, count, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(sets, pa.binary())], names=["node", "grams"])
        _hashes.clear()

    asked = nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", F.col("first.doc_id").alias("doc_id"), "t1", "t2", "copies", "bands")
    texts = with_text.join(asked.select("node", "doc_id", "t1", "t2"), ["doc_id", "t1", "t2"]).select("node", "text")
    sets = texts.mapInArrow(cut, "node long, grams binary").dropDuplicates(["node"]).join(asked.select("node", "copies", "bands"), "node")
    chunk = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int").alias("chunk")
    dealt = members.select("node", "band", "bucket", "chunks", chunk).join(sets, "node")
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")
    dealt = dealt.select("*", other).select("*", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j")).drop("other", "chunks")
    found = written(grouped(dealt, ["bucket", "i", "j"], lambda t: _bucket(t, least), "node long, links long, root long"), "links")

    labels = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), "classes")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    linked = nodes.select("node", "first").join(labels, "node").join(links, "node")
    leaders = linked.groupBy("root").agg(F.min("first").alias("leader"))
    linked = written(linked.join(leaders, "root").select("node", "links", "leader"), "linked-texts")
    known = nodes.select("t1", "t2", "copies", "node", "first").join(linked, "node", "left")
    known = known.select("t1", "t2", "copies", F.coalesce("leader", "first").alias("leader"), F.coalesce("links", F.lit(0)).alias("links"))
    out = signed.select("doc_id", "row", "t1", "t2").join(known, ["t1", "t2"])
    out = out.select("doc_id", F.col("leader.doc_id").alias("class_id"), (F.col("links") + F.col("copies") - 1).alias("n_links"), (F.col("row") == F.col("leader.row")).alias("kept"), *more)
    alone = base.filter("doc_id is null or text is null or text = ''")
    return out.unionByName(alone.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("kept"), *more))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how: float) -> DataFrame:
    """The rows of ``docs``, whole, without near copies: of each class of :func:`near_duplicates` (which takes ``how``)
    the row that it keeps. Rows are told apart by id and text, so a row stays whatever else has its id; of rows with
    the same id and text, one stays. Null and empty texts and null ids stay. An empty table gives an empty result."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("doc_id"), text.alias("text"), *text_key(text))
    compared = F.col("doc_id").isNotNull() & (F.coalesce(F.col("text"), F.lit("")) != "")
    kept = near_duplicates(docs, id_col=id_col, text_col=text_col, keys=True, **how).filter("kept").select("doc_id", "t1", "t2")
    met = rows.filter(compared).join(kept, ["doc_id", "t1", "t2"], "left_semi").dropDuplicates(["doc_id", "t1", "t2"])
    return met.select("row.*").unionByName(rows.filter(~compared).select("row.*"))
