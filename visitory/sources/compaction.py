"""Small files of many micro-batches made into few sorted ones, while readers go on.

A stream's sink puts each batch in a folder of its number. Compaction writes the rows of the batches since the last time
as one part, with files of an even number of rows for each site and day, in order of time. A part counts once a list
names it, and lists are whole: a new one is written aside and renamed. A reader takes the newest list: its parts, and the
batches behind the last one that the parts hold. So it sees the rows either where they were or where they went, never both
and never neither. Batches that are in a part are removed later, when no reader holds an older list.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import work
from .store import PARTITIONS

#: Rows of a file, about.
ROWS = 1_000_000
_LISTS = "_lists"


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; compaction keeps them few."""
    at, fs = _files(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []


def state(spark: SparkSession, path: str) -> tuple[int, list[str]]:
    """The last batch that parts hold (-1: none) and the parts, from the newest list."""
    lists = [n for n in _names(spark, f"{path}/{_LISTS}") if n.endswith(".json") and not n.startswith((".", "_"))]
    if not lists:
        return -1, []
    newest = max(lists, key=lambda n: int(n.split(".")[0]))
    told = json.loads("".join(r.value for r in spark.read.text(f"{path}/{_LISTS}/{newest}").collect()))  # one short line
    return told["last"], told["parts"]


def _batches(spark: SparkSession, path: str, after: int) -> list[int]:
    numbers = [int(n.split("=")[1]) for n in _names(spark, path) if n.startswith("batch=")]
    return sorted(n for n in numbers if n > after and "_SUCCESS" in _names(spark, f"{path}/batch={n}"))


def _rows(spark: SparkSession, path: str, folders: list[str], schema) -> DataFrame:
    """The rows of ``folders``; the columns that folder names carry come from their sites and days."""
    made = None
    for folder in folders:
        part = spark.read.schema(schema).option("basePath", f"{path}/{folder}").parquet(f"{path}/{folder}")
        made = part if made is None else made.unionByName(part)
    return spark.createDataFrame([], schema) if made is None else made


def read(spark: SparkSession, path: str, schema) -> DataFrame:
    """All stored rows, of parts and of later batches; ``schema`` with domain and day, whose bounds prune folders."""
    last, parts = state(spark, path)
    return _rows(spark, path, [*parts, *(f"batch={n}" for n in _batches(spark, path, last))], schema)


def compact(spark: SparkSession, path: str, schema, rows_of_a_file: int = ROWS) -> int:
    """Makes one part of the batches since the last. Returns how many batches it took. One compaction runs at a time."""
    last, parts = state(spark, path)
    new = _batches(spark, path, last)
    if not new:
        return 0
    rows = _rows(spark, path, [f"batch={n}" for n in new], schema)
    sizes = rows.groupBy(*PARTITIONS).count().select(*PARTITIONS, F.ceil(F.col("count") / rows_of_a_file).alias("_files"))
    dealt = rows.join(sizes, PARTITIONS).withColumn("_file", F.pmod(F.xxhash64("id"), F.col("_files")))
    dealt = dealt.repartition(*PARTITIONS, "_file").sortWithinPartitions(*PARTITIONS, "_file", "ts").drop("_files", "_file")
    part = f"part={new[0]}-{new[-1]}"
    dealt.write.mode("overwrite").partitionBy(*PARTITIONS).parquet(f"{path}/{part}")
    aside, fs = _files(spark, f"{path}/{_LISTS}/_{new[-1]}.aside")
    out = fs.create(aside, True)
    out.write(json.dumps({"last": new[-1], "parts": [*parts, part]}).encode())
    out.close()
    if not fs.rename(aside, _files(spark, f"{path}/{_LISTS}/{new[-1]}.json")[0]):
        raise OSError(f"{path}: the list of parts was not renamed")
    return len(new)


def clean(spark: SparkSession, path: str) -> int:
    """Removes the batches that parts hold, and what a compaction that failed has left. Returns how many folders went."""
    last, parts = state(spark, path)
    gone = [n for n in _names(spark, path) if (n.startswith("batch=") and int(n.split("=")[1]) <= last) or (n.startswith("part=") and n not in parts)]
    for name in gone:
        work.remove(spark, f"{path}/{name}")
    return len(gone)
