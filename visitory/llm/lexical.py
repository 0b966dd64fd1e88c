"""Ranked lexical search: the best documents of each item, by Block-Max MaxScore over an index of segments.

* **Index.** Documents are gathered in segments of some megabytes. A segment has a list for each of its terms, in blocks of
  ``BLOCK`` documents: steps between documents and counts, as variable-length bytes. Beside a block stand its last
  document and, for one occurrence, for two and for more, the shortest document (and the most occurrences), from which
  the block's highest part of a score follows whatever the corpus' statistics will be. Every term and every document is
  indexed; the index is written once and segments can be added.
* **Statistics** (documents, terms, documents of a term) are sums over the segments' rows.
* **Search.** Lists of the items' terms meet in tasks by (block of items, shard), a shard being a few segments. An item's
  lists are ordered by their highest part of a score. Those that together stay below the score of the item's k-th best
  document so far are not essential: no document is found through them alone. Documents of essential lists are scored;
  for each other list, from the strongest on, the maximum of the block a document would stand in tells whether it can
  still come up to the k-th best, and only blocks with such documents are decompressed.
* Each shard's best are merged by score and id; Spark keeps a task's best before it shuffles.

Scores are whole numbers and exact; bounds are at or above them and documents that reach a bound are kept, so ties are
right as well.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import grouped, slices, written

BEST = 20
BLOCK = 128
#: Text of a segment, terms of a shard, items of a block.
SEGMENT_BYTES, SHARD_TERMS, ITEMS = 8 << 20, 2_000_000, 1024
#: Longer terms are known by their digest, behind a byte that no text has.
LONGEST = 64
_CHUNK = 1 << 20
_NONE = 0xFFFFFFFF
#: One byte for each byte: A-Z become a-z, other ASCII than digits and letters a space; the rest stays.
_FOLD = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, some at a time."""
    folded, at = text.translate(_FOLD), 0
    while at < len(folded):
        end = at + _CHUNK
        if end < len(folded):
            end = folded.find(b" ", end)
            end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


def key(term: bytes) -> bytes:
    return term if len(term) <= LONGEST else b"\xff" + hashlib.blake2b(term, digest_size=32).digest()


def _pack(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers in seven bits a byte, low ones first, and where each begins (one more for the end)."""
    size = 1 + sum((numbers >= 1 << 7 * k).astype(np.int64) for k in range(1, 5))
    at = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(at[-1], dtype=np.uint8)
    for k in range(5):
        some = np.flatnonzero(size > k)
        if len(some):
            out[at[some] + k] = (numbers[some] >> 7 * k & 127) | np.where(size[some] > k + 1, 128, 0)
    return out, at


def _unpack(data: np.ndarray) -> np.ndarray:
    first = np.concatenate([[0], np.flatnonzero(data < 128)[:-1] + 1])
    place = np.arange(len(data)) - np.repeat(first, np.diff(np.append(first, len(data))))
    return np.add.reduceat((data & 127).astype(np.int64) << 7 * place, first)


def _segment(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lists of some texts: terms, documents of each, rows of blocks (last document, first byte, shortest document
    with one, two and more occurrences, most occurrences), first block of each term, bytes, first byte of each term; and
    the terms of each text."""
    known: dict[bytes, int] = defaultdict()
    known.default_factory = known.__len__
    ids, lengths = [], np.zeros(len(texts), dtype=np.int64)
    for k, text in enumerate(texts):
        for some in terms(text):
            ids.append(np.fromiter(map(known.__getitem__, some), np.int64, len(some)))
            lengths[k] += len(some)
    every = np.concatenate(ids) if ids else np.zeros(0, dtype=np.int64)
    pair, tf = np.unique(every << 32 | np.repeat(np.arange(len(texts)), lengths), return_counts=True)
    term, doc = pair >> 32, pair & _NONE
    count = np.bincount(term, minlength=len(known))
    first = np.concatenate([[0], np.cumsum(count)])
    inside = np.arange(len(doc)) - np.repeat(first[:-1], count)
    step = np.diff(doc, prepend=-1)
    step[inside == 0] = doc[inside == 0] + 1
    data, at = _pack(np.stack([step, tf], axis=1).ravel())
    starts = np.flatnonzero(inside % BLOCK == 0)
    block_of = np.concatenate([[0], np.cumsum(-(-count // BLOCK))])
    data_of = at[2 * first]
    n = lengths[doc]
    rows = np.zeros((len(starts), 6), dtype=np.uint32)
    if len(starts):
        rows[:, 0] = doc[np.append(starts[1:], len(doc)) - 1]
        rows[:, 1] = at[2 * starts] - np.repeat(data_of[:-1], np.diff(block_of))
        for c, some in ((2, tf == 1), (3, tf == 2), (4, tf > 2)):
            rows[:, c] = np.minimum.reduceat(np.where(some, n, _NONE), starts)
        rows[:, 5] = np.maximum.reduceat(tf, starts)
    return [key(t) for t in known], count, rows, block_of, data, data_of, lengths


def _binary(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """The index of ``docs``: rows (segment, turn, term, df, total, heads, data, ids).

    A row for each term of each segment; and one with an empty term for the segment itself, with its documents that
    have terms (df), all their terms (total), the terms of each document (data) and the documents' ids.
    """
    wanted = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    kind = wanted.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0

        def close(ids: pa.Array, texts: list[bytes]) -> pa.RecordBatch:
            nonlocal made
            keys, count, rows, block_of, data, data_of, lengths = _segment(texts)
            made += 1
            n = len(keys) + 1
            own, _ = _pack(lengths)
            lists = pa.ListArray.from_arrays(pa.array([0] * n + [len(ids)], pa.int32()), ids)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, part << 20 | made - 1), pa.int64()),
                    pa.array(np.full(n, part + 7919 * (made - 1)), pa.int64()),
                    pa.array([*keys, b""], pa.binary()),
                    pa.array(np.append(count, np.count_nonzero(lengths)), pa.int64()),
                    pa.array(np.append(np.zeros(n - 1, dtype=np.int64), lengths.sum()), pa.int64()),
                    _binary(rows, np.append(24 * block_of, 24 * block_of[-1])),
                    _binary(np.concatenate([data, own]), np.append(data_of, data_of[-1] + len(own))),
                    lists,
                ],
                names=["segment", "turn", "term", "df", "total", "heads", "data", "ids"],
            )

        held, texts, size = [], [], 0
        for b in slices(batches, "text"):
            column, at = b.column("text"), 0
            for k in range(b.num_rows):
                text = column[k].as_py()
                texts.append(text)
                size += len(text) + 8
                if size >= segment_bytes:
                    held.append(b.column("doc_id").slice(at, k + 1 - at))
                    yield close(pa.concat_arrays(held), texts)
                    held, texts, size, at = [], [], 0, k + 1
            held.append(b.column("doc_id").slice(at))
        if texts:
            yield close(pa.concat_arrays(held), texts)

    return wanted.mapInArrow(run, f"segment long, turn long, term binary, df long, total long, heads binary, data binary, ids array<{kind}>")


def _lengths_to_m(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """100 - 25 + (25 n N) div L, in Python's numbers where 64 bits might not hold the product."""
    if len(n) and int(n.max()) * 25 * n_docs >= 1 << 62:
        return np.array([75 + 25 * int(x) * n_docs // n_terms for x in n], dtype=np.int64)
    return 75 + 25 * n * n_docs // n_terms


def _part(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


class Shard:
    """Some segments as one range of documents."""

    def __init__(self, segments: list[tuple[int, list, np.ndarray]], n_docs: int, n_terms: int):
        """``segments``: number, ids and terms of each document."""
        self.base, self.ids, lengths = {}, [], []
        for number, ids, n in segments:
            self.base[number] = len(self.ids)
            self.ids += ids
            lengths.append(n)
        self.n_docs, self.n_terms = n_docs, n_terms
        self.m = _lengths_to_m(np.concatenate(lengths), n_docs, n_terms)
        order = sorted(range(len(self.ids)), key=lambda k: (self.ids[k] is None, self.ids[k] if self.ids[k] is not None else 0))
        self.rank = np.empty(len(order), dtype=np.int64)
        self.rank[order] = np.arange(len(order))


class List:
    """The documents of a term in a shard; blocks are decompressed when first asked for, and only once."""

    def __init__(self, shard: Shard, pieces: list[tuple[int, int, bytes, bytes]], df: int):
        """``pieces``: segment, documents, heads and data of each, by base."""
        self.shard = shard
        self.weight = math.floor(1000 * math.log((2 * shard.n_docs + 2) / (2 * df + 1)))
        last, n, base, heads, ends, shift = [], [], [], [], [], 0
        self.data = np.frombuffer(b"".join(p[3] for p in pieces), np.uint8)
        for segment, count, head, data in pieces:
            rows = np.frombuffer(head, np.uint32).reshape(-1, 6).astype(np.int64)
            first = shard.base[segment]
            last.append(rows[:, 0] + first)
            base.append(np.concatenate([[first - 1], rows[:-1, 0] + first]))
            n.append(np.minimum(BLOCK, count - BLOCK * np.arange(len(rows))))
            ends.append(np.append(rows[1:, 1], len(data)) + shift)
            heads.append(rows)
            shift += len(data)
        self.last, self.before, self.n, self.end = (np.concatenate(x) for x in (last, base, n, ends))
        rows = np.concatenate(heads)
        best = np.zeros(len(rows), dtype=np.int64)
        for c, tf in ((2, 1), (3, 2), (4, None)):
            some = np.flatnonzero(rows[:, c] != _NONE)
            if len(some):
                best[some] = np.maximum(best[some], _part(rows[some, 5] if tf is None else np.full(len(some), tf), _lengths_to_m(rows[some, c], shard.n_docs, shard.n_terms)))
        self.best, self.most = best, int(best.max())
        self.first = np.concatenate([[0], np.cumsum(self.n)])
        # a block not yet read stands for its last document, which keeps the list in order
        self.docs = np.repeat(self.last, self.n)
        self.parts = np.zeros(self.first[-1], dtype=np.int64)
        self.ready = np.zeros(len(rows), dtype=bool)
        self.all_ready = False

    def read(self, blocks: np.ndarray) -> None:
        """Decompresses those of ``blocks`` (ascending) that are not yet."""
        if self.all_ready:
            return
        blocks = blocks[~self.ready[blocks]]
        if not len(blocks):
            return
        starts = np.where(blocks > 0, self.end[blocks - 1], 0)
        data = np.concatenate([self.data[a:b] for a, b in zip(starts, self.end[blocks], strict=True)]) if len(blocks) < len(self.last) else self.data
        step, tf = _unpack(data).reshape(-1, 2).T
        n = self.n[blocks]
        total = np.cumsum(step)
        head = np.concatenate([[0], np.cumsum(n)[:-1]])
        docs = total + np.repeat(self.before[blocks] - (total[head] - step[head]), n)
        at = np.repeat(self.first[blocks] - head, n) + np.arange(len(docs))
        self.docs[at] = docs
        self.parts[at] = _part(tf, self.shard.m[docs])
        self.ready[blocks] = True
        self.all_ready = bool(self.ready.all())

    def between(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents from a to b (without) and their parts."""
        first, last = np.searchsorted(self.last, [a, b])
        self.read(np.arange(first, min(last + 1, len(self.last))))
        x, y = np.searchsorted(self.docs, [a, b])
        return self.docs[x:y], self.parts[x:y]


def search(shard: Shard, wanted: list[tuple[List, int]], k: int = BEST) -> tuple[np.ndarray, np.ndarray]:
    """The k best documents (numbers and scores) for lists with repeats."""
    uses = sorted(((repeats * x.weight * x.most, repeats * x.weight, x) for x, repeats in wanted if x.weight), key=lambda u: u[0])
    below = np.cumsum([0] + [u[0] for u in uses])  # all that the first so many lists can add
    docs, scores, floor = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), 0
    n, a = len(shard.ids), 0
    window = max(1024, n // 32)
    while a < n:
        b = min(n, a + window)
        window *= 8
        essential = int(np.searchsorted(below, floor, side="left")) - 1 if floor else 0  # lists from here on
        score = np.zeros(b - a, dtype=np.int64)
        for _, weight, x in uses[essential:]:
            at, parts = x.between(a, b)
            score[at - a] += weight * parts
        found = np.flatnonzero(score)
        got = score[found]
        if len(docs) + len(found) >= k:  # what is summed up already bounds the k-th best from below
            floor = max(floor, int(np.partition(np.concatenate([scores, got]), -k)[-k]))
        keep = got + below[essential] >= floor
        found, got = found[keep] + a, got[keep]
        for j in range(essential - 1, -1, -1):
            if not len(found):
                break
            _, weight, x = uses[j]
            block = np.searchsorted(x.last, found)
            inside = block < len(x.last)
            most = np.where(inside, weight * x.best[np.minimum(block, len(x.last) - 1)], 0)
            keep = got + most + below[j] >= floor
            found, got, block, inside = found[keep], got[keep], block[keep], inside[keep]
            x.read(np.unique(block[inside]))
            at = np.minimum(np.searchsorted(x.docs, found), len(x.docs) - 1)
            got = got + np.where(inside & (x.docs[at] == found), weight * x.parts[at], 0)
        keep = (got >= floor) & (got > 0)
        docs, scores = np.concatenate([docs, found[keep]]), np.concatenate([scores, got[keep]])
        order = np.lexsort((shard.rank[docs], -scores))[:k]
        docs, scores = docs[order], scores[order]
        if len(docs) == k:
            floor = int(scores[-1])
        a = b
    return docs, scores


def _item_terms(items: DataFrame) -> DataFrame:
    """(block, item, term, repeats) of items (block, item, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            rows = []
            for block, item, text in zip(b.column("block").to_pylist(), b.column("item").to_pylist(), b.column("text").to_pylist(), strict=True):
                count: dict[bytes, int] = defaultdict(int)
                for some in terms(text):
                    for t in some:
                        count[t] += 1
                rows += [(block, item, key(t), c) for t, c in count.items()]
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds[c]) for c in range(4)], names=["block", "item", "term", "repeats"])

    return items.mapInArrow(run, "block long, item long, term binary, repeats long")


def ranked(items: DataFrame, made: DataFrame, k: int = BEST, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The ``k`` best documents of the index ``made`` for each item: item_id, rank (int, from 1), doc_id, score.

    Only scores above 0 count; equal scores go by ascending doc_id, a null one last. Items whose text is null, empty or
    without a known term have no rows. Every row of ``items`` is an item of its own, also if it repeats an id or has
    none, and every document is one of its own likewise. An index without terms gives an empty result.
    """
    kind = made.schema["ids"].dataType.elementType.simpleString()
    item_kind = items.schema[item_col].dataType.simpleString()
    own = made.filter(F.col("term") == F.lit(b""))
    whole = own.agg(F.sum("df").alias("n"), F.sum("total").alias("l")).first()
    n_docs, n_terms = whole["n"] or 0, whole["l"] or 0
    if not n_terms:
        return items.sparkSession.createDataFrame([], f"item_id {item_kind}, rank int, doc_id {kind}, score long")
    numbered = items.select(F.col(item_col).alias("item_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    numbered = written(numbered.withColumn("item", F.monotonically_increasing_id()), "items")
    n_blocks = max(1, -(-numbered.count() // ITEMS))
    numbered = numbered.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(n_blocks)))
    asked = _item_terms(numbered).groupBy("block", "term").agg(F.sort_array(F.collect_list(F.struct("item", "repeats"))).alias("users"))
    asked = written(asked, "item-terms")

    shards = max(1, -(-n_terms // SHARD_TERMS))
    shard = F.pmod("turn", F.lit(shards)).alias("shard")
    # the lists of the items' terms, over all segments
    lists = made.filter(F.col("term") != F.lit(b"")).join(asked.select("term").distinct(), "term", "left_semi")
    lists = written(lists.select(shard, "segment", "term", "df", "heads", "data"), "item-lists")
    frequency = lists.groupBy("term").agg(F.sum("df").alias("everywhere"))
    meets = asked.join(frequency, "term")
    lists = lists.join(meets, "term").select("block", "shard", "segment", "term", "df", "everywhere", "heads", "data", "users")
    segments = own.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))).alias("block"), shard, "segment", "df", "data", "ids")
    rows = segments.unionByName(lists, allowMissingColumns=True)

    def run(table: pa.Table) -> pa.RecordBatch | None:
        c = {name: table.column(name).to_pylist() for name in ("segment", "term", "df", "everywhere", "heads", "data")}
        ids = table.column("ids")
        mine = sorted((s, k) for k, (s, t) in enumerate(zip(c["segment"], c["term"], strict=True)) if t is None)
        here = Shard([(s, ids[k].as_py(), _unpack(np.frombuffer(c["data"][k], np.uint8))) for s, k in mine], n_docs, n_terms)
        pieces: dict[bytes, list[int]] = defaultdict(list)
        for k, t in enumerate(c["term"]):
            if t is not None:
                pieces[t].append(k)
        wanted: dict[int, list[tuple[List, int]]] = defaultdict(list)
        for at in pieces.values():
            at.sort(key=lambda k: here.base[c["segment"][k]])
            made_list = List(here, [(c["segment"][k], c["df"][k], c["heads"][k], c["data"][k]) for k in at], c["everywhere"][at[0]])
            for user in table.column("users")[at[0]].as_py():
                wanted[user["item"]].append((made_list, user["repeats"]))
        out = [(item, here.ids[d], int(s)) for item, lists in wanted.items() for d, s in zip(*search(here, lists, k), strict=True)]
        if not out:
            return None
        kinds = (pa.int64(), ids.type.value_type, pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], kinds[j]) for j in range(3)], names=["item", "doc_id", "score"])

    found = grouped(rows, ["block", "shard"], run, f"item long, doc_id {kind}, score long", spread=True)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    top = found.withColumn("rank", rank).filter(F.col("rank") <= k)
    return top.join(numbered.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def best(docs: DataFrame, items: DataFrame, k: int = BEST) -> DataFrame:
    """:func:`ranked` over a new index of ``docs``."""
    return ranked(items, written(index(docs), "lexical-index"), k)


ORACLE_SQL = r"""
WITH words AS MATERIALIZED (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), asked AS MATERIALIZED (
  SELECT item_id, term, count(*) AS repeats FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL
), lengths AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
whole AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM lengths),
held AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM held, whole GROUP BY term
), scored AS (
  SELECT item_id, doc_id, CAST(sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM asked JOIN held USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id), whole GROUP BY ALL
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 20
"""
