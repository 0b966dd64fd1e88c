"""A uniform shuffle of all rows into shards of exact sizes, with DataFrame functions only.

The law is ``rows``: shards differ by one row at most. Four steps make every order of the rows equally likely:

1. Rows are dealt by hash to ``BLOCKS`` blocks, and only the rows of each block are counted.
2. From these counts and the exact shard sizes the driver draws the communication matrix: how many rows each block
   sends to each shard. Its rows follow the multivariate hypergeometric law that a shuffle of all rows would give them.
   The matrix has blocks x shards numbers, whatever the size of the corpus.
3. Each block is permuted by itself (a rank by a hashed key), and its ranks are cut as the matrix says.
4. Rows are exchanged and permuted again in their shard. A shard is ordered by a second hashed key whose upper bits
   make cells, and running sums of the cells' sizes give each its first slot, so no task holds a whole shard.

All keys are hashes of the rows and of ``seed``, so a task that runs again after a loss gives the same rows, and the
result does not depend on partitions. Equal texts are rows like others; a uniform shuffle spreads them.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

BLOCKS = 2048
#: Cells of a shard, as upper bits of its order's key.
CELL_BITS = 8
SHARDS = 8
LAW = "rows"


def hypergeometric(rnd: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` balls are good, drawn without return from ``good`` and ``bad`` ones: inversion outwards
    from the most likely number, so the steps are about one standard deviation."""
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low

    def ways(n: int, k: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    most = math.exp(ways(good, mode) + ways(bad, draws - mode) - ways(good + bad, draws))
    while True:
        left = rnd.random() - most
        up = down = mode
        p_up = p_down = most
        while left >= 0 and (up < high or down > low) and max(p_up, p_down) > 1e-18:
            if up < high:
                p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
                up += 1
                left -= p_up
                if left < 0:
                    return up
            else:
                p_up = 0.0
            if down > low:
                p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
                down -= 1
                left -= p_down
                if left < 0:
                    return down
            else:
                p_down = 0.0
        if left < 0:
            return mode
        # rounding left a little of the law out: draw again


def matrix(counts: list[int], sizes: list[int], rnd: random.Random) -> list[list[int]]:
    """For each block how many of its rows go to each shard; rows add up to ``counts``, columns to ``sizes``."""
    left, out = list(sizes), []
    for count in counts:
        room, row = sum(left), []
        for k, free in enumerate(left):
            n = hypergeometric(rnd, free, room - free, count)
            room, count, left[k] = room - free, count - n, free - n
            row.append(n)
        out.append(row)
    return out


def _cuts(spark: SparkSession, rows: list[list[int]]) -> DataFrame:
    """(block, ends): the ranks at which a block's rows for each shard end; blocks x shards numbers in all."""
    ends = []
    for row in rows:
        total = 0
        ends.append([total := total + n for n in row])
    text = str(ends)
    return spark.range(1).select(F.posexplode(F.from_json(F.lit(text), "array<array<bigint>>")).alias("block", "ends"))


def shuffled(rows: DataFrame, shards: int = SHARDS, seed: int = 13, salt: Column | None = None) -> DataFrame:
    """Every row of ``rows`` with its shard and its slot there.

    Returns row (a struct of all columns, whatever their names), shard (int, 0 to ``shards`` - 1) and slot (long,
    gapless from 0 in each shard). Shard sizes differ by one at most, the first shards being larger. Rows are told
    apart by all their columns, and by ``salt`` where given; rows equal in all share a block and a cell, and which of
    them takes which slot makes no difference. Nulls in any column are values like others. An empty table gives an
    empty result; of fewer rows than shards the last shards stay empty.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    spark = rows.sparkSession
    # hashes do not take maps
    plain = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() or "variant" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in rows.schema.fields]
    each = [F.lit(seed), *plain] + ([salt] if salt is not None else [])
    at = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), F.xxhash64(*each).alias("mark"), F.xxhash64(F.lit(1), *each).alias("mark2"))
    at = at.withColumn("block", F.pmod(F.xxhash64(F.lit(2), "mark"), F.lit(BLOCKS)).cast("int"))
    counts = [0] * BLOCKS
    for r in at.groupBy("block").count().collect():  # BLOCKS rows at most
        counts[r["block"]] = r["count"]
    n = sum(counts)
    sizes = [n // shards + (k < n % shards) for k in range(shards)]
    cuts = _cuts(spark, matrix(counts, sizes, random.Random(seed)))

    rank = F.row_number().over(Window.partitionBy("block").orderBy(F.xxhash64(F.lit(3), "mark"), "mark", "mark2"))
    dealt = at.withColumn("rank", rank).join(F.broadcast(cuts), "block")
    order = F.xxhash64(F.lit(4), "mark")
    dealt = dealt.select("row", "mark", "mark2", F.size(F.filter("ends", lambda end: end < F.col("rank"))).alias("shard"), order.alias("order"))
    dealt = written(dealt.withColumn("cell", F.shiftrightunsigned("order", 64 - CELL_BITS).cast("int")), "dealt")

    cells = dealt.groupBy("shard", "cell").count()  # shards x cells rows at most
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    firsts = cells.select("shard", "cell", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    inside = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("order", "mark", "mark2"))
    placed = dealt.withColumn("inside", inside).join(F.broadcast(firsts), ["shard", "cell"])
    return placed.select("row", "shard", (F.col("first") + F.col("inside") - 1).alias("slot"))


def write(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = 13, files: int = 1) -> None:
    """Writes the shuffled rows of ``docs`` as Parquet, a folder for each shard; a shard has ``files`` files or so, each
    a range of slots in order."""
    found = shuffled(docs, shards, seed).select("row.*", F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
    found = found.repartitionByRange(shards * files, "_shard", "_slot").sortWithinPartitions("_shard", "_slot")
    found.write.partitionBy("_shard").parquet(path)


def facts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size (UTF-8 bytes and 1; a null text has none) and text_crc32 of every document."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))


def assignments(docs: DataFrame, shards: int = SHARDS, seed: int = 13) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null under this law) of every document.

    Only these facts move, never texts. Documents without an id are numbered as they are read, so that many of them
    are not one key. Documents that repeat an id are documents of their own.
    """
    number = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
    kept = written(facts(docs).withColumn("number", number), "document-facts")
    found = shuffled(kept, shards, seed)
    return found.select("row.doc_id", "row.size", "row.text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
