"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, named by ``spark.checkpoint.dir``.

    Only a local master may go without the setting; a cluster has no folder that could stand in for it.
    """
    base = spark.conf.get("spark.checkpoint.dir", "")
    if not base:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """``df`` written as Parquet in a new folder of :func:`shared_dir` and read again.

    The result has no lineage behind it and survives the loss of executors. The folder goes at the end of the
    :func:`scratch` block around the call, if there is one; else it is the caller's to clear.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for made in _MADE:
        made.append(path)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_MADE: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes, at the end of the block, the folders that :func:`written` made in it, but for those behind the tables
    that were handed to the function it gives. Use it where the block's result is written itself: a table that still
    has to be computed from a folder must be kept."""
    made: list[str] = []
    kept: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.extend(df.inputFiles())
        return df

    _MADE.append(made)
    try:
        yield keep
    finally:
        _MADE.remove(made)
        context = spark.sparkContext
        for path in made:
            name = path.rsplit("/", 1)[1]
            if not any(f"/{name}/" in file for file in kept):
                folder = context._jvm.org.apache.hadoop.fs.Path(path)
                folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches by rows so that ``column`` (string or binary) holds about ``most_bytes`` in each piece."""
    for batch in batches:
        rows, at = batch.num_rows, 0
        values = batch.column(column)
        step = max(1, rows * most_bytes // max(1, values.nbytes))
        while at < rows:
            n = min(step, rows - at)
            while n > 1 and values.slice(at, n).nbytes > 2 * most_bytes:
                n //= 2
            yield batch.slice(at, n)
            at += n
    # workers live on for other operators
    pa.default_memory_pool().release_unused()


def connected_components(edges: DataFrame, name: str, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a long, b long): root is the smallest node that links reach.

    Rounds of hooking and pointer jumping: each node's root becomes the smallest root among its neighbours, then the
    root's own root. Nodes with very many links cost no more than others, since each round only takes a minimum by
    key, which Spark combines before it shuffles. Every round is written to the shared folder.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = written(both.filter("a <> b").distinct(), f"{name}-links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), f"{name}-r0")
    for k in range(1, most_rounds + 1):
        near = both.join(labels.select(F.col("node").alias("b"), F.col("root")), "b")
        hooked = near.groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        hooked = labels.join(hooked, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        # a node hands what it has found to its old root as well, so whole trees move at once
        found = hooked.select("node", "root").union(hooked.select(F.col("old").alias("node"), "root"))
        found = found.groupBy("node").agg(F.min("root").alias("root"))
        up = found.select(F.col("node").alias("root"), F.col("root").alias("higher"))
        jumped = found.join(up, "root", "left").select("node", F.least("root", F.coalesce("higher", "root")).alias("root"))
        after = written(jumped, f"{name}-r{k}")
        moved = after.join(labels.withColumnRenamed("root", "was"), "node").filter("root <> was").limit(1).count()
        labels = after
        if not moved:
            return labels
    raise RuntimeError(f"{name}: components did not settle in {most_rounds} rounds")


def grouped(df: DataFrame, keys: list[str], run, schema: str, spread: bool = False) -> DataFrame:
    """``run(table)`` for the rows of each distinct ``keys``, as an Arrow table; it returns an Arrow batch or None.

    One shuffle and one sort by the keys; a task holds the rows of one group at a time. Cheaper than a grouped map for
    many small groups. Callers bound the size of a group through the keys. ``spread`` keeps as many partitions as
    shuffles have, for groups that take long although they are small.
    """

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        at = None

        def done() -> Iterator[pa.RecordBatch]:
            if held and (out := run(pa.Table.from_batches(held).combine_chunks())) is not None:
                yield out

        for b in batches:
            if not b.num_rows:
                continue
            marks = list(zip(*(b.column(k).to_pylist() for k in keys), strict=True))
            first = 0
            for i, mark in enumerate(marks):
                if mark != at:
                    if i > first:
                        held.append(b.slice(first, i - first))
                    yield from done()
                    held, first, at = [], i, mark
            held.append(b.slice(first))
        yield from done()

    most = [int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))] if spread else []
    dealt = df.repartition(*most, *keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(over, schema)
