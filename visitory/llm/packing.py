"""Best-fit packing of token pieces into sequences, planned on the histogram of lengths.

A document's ids and one end id are cut into pieces of at most ``size`` ids. The driver sees only how many pieces have
each length (at most ``size`` numbers) and plans best-fit over these counts, longest first: all pieces of one length
that meet open sequences with the same free room fill them in one step. The plan is a table of runs (length, ranks
from-to, first sequence, offset), whose size depends on ``size`` and not on the corpus. Pieces then take the planned
slots by their rank within their length.

Ranks need no sort by length: pieces are numbered inside their own file's rows, and a running sum over the (file,
length) counts gives each file its first rank, so one length that a third of all pieces share stays spread out.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import load
from .common import slices, written

SIZE = 4096
END = 1


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: runs (length, first rank, pieces, first sequence, offset)."""
    runs: list[tuple[int, int, int, int, int]] = []
    room: dict[int, list[tuple[int, int]]] = {}  # free ids -> runs of sequences (first, how many)
    rooms: list[int] = []  # keys of room, ascending
    made = 0

    def put(free: int, first: int, n: int) -> None:
        if free:
            if free not in room:
                room[free] = []
                bisect.insort(rooms, free)
            room[free].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            k = bisect.bisect_left(rooms, length)
            if k == len(rooms):
                each = size // length
                if each > 1 and left >= each:
                    # new sequences filled with this length alone, as best-fit would do one piece at a time
                    n = left // each
                    for j in range(each):
                        runs.append((length, rank, n, made, j * length))
                        rank += n
                    left -= n * each
                    put(size - each * length, made, n)
                else:
                    n = left if each == 1 else 1
                    here = 1 if each == 1 else left
                    for j in range(here):
                        runs.append((length, rank, n, made, j * length))
                        rank += n
                    left -= n * here
                    put(size - here * length, made, n)
                made += n
                continue
            free = rooms[k]
            first, n = room[free].pop()
            if not room[free]:
                del room[free]
                rooms.pop(k)
            used = min(n, left)
            if used < n:
                put(free, first + used, n - used)
            # a sequence takes as many of this length as fit before the next one is opened
            each = min(free // length, max(1, left // used))
            for j in range(each):
                runs.append((length, rank, used, first, size - free + j * length))
                rank += used
            left -= used * each
            put(free - each * length, first, used)
    return runs


def pieces(docs: DataFrame, path: str, size: int = SIZE, end: int = END, id_col: str = "doc_id", text_col: str = "text", ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, unless told otherwise, ids (binary) of every document's ids with ``end`` behind them. A null or empty
    text is one piece that holds ``end`` alone."""
    wanted = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = wanted.schema["doc_id"].dataType.simpleString()
    last = int(end).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in slices(batches, "text", 1 << 20):
            rows = [
                (k // size, k, x[4 * k : 4 * (k + size)], d)
                for d, x in enumerate(i + last for i in bpe.encode(b.column("text").to_pylist()))
                for k in range(0, len(x) // 4, size)
            ]
            columns = {
                "doc_id": b.column("doc_id").take(pa.array([r[3] for r in rows], pa.int64())),
                "piece": pa.array([r[0] for r in rows], pa.int32()),
                "start": pa.array([r[1] for r in rows], pa.int64()),
                "length": pa.array([len(r[2]) // 4 for r in rows], pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(r[2]) for r in rows], pa.int64()),
            }
            if ids:
                columns["ids"] = pa.array([r[2] for r in rows], pa.binary())
            yield pa.RecordBatch.from_pydict(columns)

    return wanted.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + (", ids binary" if ids else ""))


def place(rows: DataFrame, size: int = SIZE) -> DataFrame:
    """Adds sequence_id and offset to ``rows``, whose column length is between 1 and ``size``.

    ``rows`` is written first, so that the two passes see the same rows in the same files. Sequence numbers are
    gapless from 0. Which of several pieces of one length takes which slot depends on the files; any choice packs
    equally well. An empty table gives an empty result.
    """
    spark = rows.sparkSession
    names = rows.columns
    kept = written(rows.withColumn("_part", F.spark_partition_id()), "pieces")
    held = kept.groupBy("_part", "length").count()
    held = written(held, "lengths")
    runs = plan({r["length"]: r["n"] for r in held.groupBy("length").agg(F.sum("count").alias("n")).collect()}, size)
    slots = spark.createDataFrame(runs, "length long, rank_from long, n long, first_sequence long, offset long")
    # (part, length) -> its ranks; at most size rows for each part, which grows with the parts: merged, not broadcast
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = held.select("_part", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_first")).hint("merge")
    within = Window.partitionBy("_part", "length").orderBy("doc_id", "piece", "ids_crc32")
    ranked = kept.withColumn("_rank", F.row_number().over(within) - 1).join(firsts, ["_part", "length"])
    ranked = ranked.withColumn("_rank", F.col("_rank") + F.col("_first"))
    fits = (F.col("p.length") == F.col("s.length")) & F.col("p._rank").between(F.col("s.rank_from"), F.col("s.rank_from") + F.col("s.n") - 1)
    # the plan has a proven bound: it depends on size alone
    placed = ranked.alias("p").join(F.broadcast(slots.alias("s")), fits)
    return placed.select(*[F.col(f"p.{c}") for c in names], (F.col("s.first_sequence") + F.col("p._rank") - F.col("s.rank_from")).alias("sequence_id"), F.col("s.offset"))


def pack(docs: DataFrame, path: str, size: int = SIZE, end: int = END, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """Packs all documents of ``docs`` into sequences of at most ``size`` ids.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, with ``ids`` also the piece's ids.
    Documents longer than ``size`` are cut there, others never. Repeated rows are packed as often as they occur, null
    doc_ids stay null, and other columns of ``docs`` are not read.
    """
    return place(pieces(docs, path, size, end, id_col, text_col, ids), size)
