"""Rollups: partial sums and sets of visitors by site, bucket, property and value, from which all metrics are made.

A rollup is two tables. ``sums`` has the additive figures of each cell. ``ids`` has its visitors, cut by the number of
the visitor into chunks of 32,768: a chunk of few visitors lists their places, a full one is a bitmap of 4 KB. Both
tables can be added up: over buckets to coarser ones, over sites, and over loads, and the result is what the hits
themselves would have given, as a visitor counts once however many rows have them.

The count of a union needs no decompression: bitmaps of a chunk are united, listed places are made distinct, and those
that stand in the bitmap of their chunk are left out. A reader of a month reads days and values, not hits.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import buckets
from ..schema import PROPERTIES
from ..sources import work
from . import filters, metrics

CELL = ["domain", "bucket", "prop", "value"]
SUMS = ["visits", "pageviews", "events", "bounce", "duration"]
#: Chunks of more visitors are bitmaps; a list of so many takes about as much.
SPARSE = 1000
#: The property of totals.
ALL = ""


@dataclass(frozen=True)
class Rollup:
    """``sums``: CELL, SUMS. ``ids``: CELL, chunk, places (array of int) or bitmap (binary)."""

    sums: DataFrame
    ids: DataFrame

    def where(self, condition: Column | str) -> Rollup:
        return Rollup(self.sums.filter(condition), self.ids.filter(condition))

    def kept(self) -> Rollup:
        """Both tables written once, for several uses."""
        return Rollup(work.written(self.sums, "rollup-sums"), work.written(self.ids, "rollup-ids"))

    def union(self, other: Rollup) -> Rollup:
        return Rollup(self.sums.unionByName(other.sums), self.ids.unionByName(other.ids))


def _listed(points: DataFrame, keys: list[str]) -> DataFrame:
    """``points`` (keys, chunk, place; distinct) as lists, or bitmaps where they are many."""
    listed = points.groupBy(*keys, "chunk").agg(F.array_sort(F.collect_list("place")).alias("places"))
    few = listed.filter(F.size("places") <= SPARSE).select(*keys, "chunk", "places", F.lit(None).cast("binary").alias("bitmap"))
    many = listed.filter(F.size("places") > SPARSE).select(*keys, "chunk", F.explode("places").alias("place"))
    many = many.groupBy(*keys, "chunk").agg(F.bitmap_construct_agg("place").alias("bitmap"))
    return few.unionByName(many.select(*keys, "chunk", F.lit(None).cast("array<int>").alias("places"), "bitmap"))


def of(hits: DataFrame, interval: str, props: Iterable[str] = PROPERTIES) -> Rollup:
    """The rollup of hits with their part in their visit: a cell for each bucket and site (property and value empty) and
    for each value of ``props`` that is not null. Hits without a visitor count in the sums alone."""
    pairs = [F.struct(F.lit(p).alias("prop"), F.col(filters.column(p)).cast("string").alias("value")) for p in props]
    cells = F.explode(F.array(F.struct(F.lit(ALL).alias("prop"), F.lit("").alias("value")), *pairs)).alias("cell")
    start = buckets.bucket(F.col("ts"), interval).alias("bucket")
    rows = hits.select("domain", start, "id", "session", "view", "bounce", "duration", cells).filter("cell.value is not null")
    rows = rows.select("domain", "bucket", "cell.prop", "cell.value", "id", "session", "view", "bounce", "duration")
    sums = rows.groupBy(*CELL).agg(
        F.count_if("session").alias("visits"),
        F.count_if("view").alias("pageviews"),
        F.count("*").alias("events"),
        F.coalesce(F.sum("bounce"), F.lit(0)).cast("long").alias("bounce"),
        F.coalesce(F.sum("duration"), F.lit(0)).cast("long").alias("duration"),
    )
    points = rows.filter("id is not null").select(*CELL, F.bitmap_bucket_number("id").alias("chunk"), F.bitmap_bit_position("id").cast("int").alias("place")).distinct()
    return Rollup(sums, _listed(points, CELL))


def merged(rollup: Rollup, interval: str | None = None) -> Rollup:
    """One row for each cell and chunk, added up over loads, and over buckets where a coarser ``interval`` is named."""
    sums, ids = rollup.sums, rollup.ids
    if interval is not None:
        start = buckets.bucket(F.col("bucket"), interval)
        sums, ids = sums.withColumn("bucket", start), ids.withColumn("bucket", start)
    sums = sums.groupBy(*CELL).agg(*[F.sum(c).alias(c) for c in SUMS])
    key = [*CELL, "chunk"]
    bitmaps = ids.filter("bitmap is not null").select(*key, "bitmap")
    points = ids.filter("places is not null").select(*key, F.explode("places").alias("place")).distinct()
    full = bitmaps.select(*key).distinct()
    joined = points.join(full, key, "left_semi").groupBy(*key).agg(F.bitmap_construct_agg("place").alias("bitmap"))
    dense = bitmaps.unionByName(joined).groupBy(*key).agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
    dense = dense.select(*key, F.lit(None).cast("array<int>").alias("places"), "bitmap")
    return Rollup(sums, _listed(points.join(full, key, "left_anti"), CELL).unionByName(dense))


def _is_set(bitmap: Column, place: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.call_function("shiftright", byte, (place % 8).cast("int")).bitwiseAND(F.lit(1)) == 1


def visitors(ids: DataFrame, by: list[str]) -> DataFrame:
    """How many different visitors the rows of each group of ``by`` hold, as a column ``visitors``."""
    key = [*by, "chunk"]
    bitmaps = ids.filter("bitmap is not null").groupBy(*key).agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
    points = ids.filter("places is not null").select(*key, F.explode("places").alias("place")).distinct()
    alone = points.join(bitmaps, key, "left").filter(F.col("bitmap").isNull() | ~_is_set(F.col("bitmap"), F.col("place")))
    counts = bitmaps.select(*by, F.bitmap_count("bitmap").alias("n")).unionByName(alone.groupBy(*by).agg(F.count("*").alias("n")))
    return counts.groupBy(*by).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("visitors"))


def measure(rollup: Rollup, by: list[str], names: Iterable[str]) -> DataFrame:
    """One row for each group of ``by`` (columns of CELL; one row in all without any) with metrics as DOUBLE. Only
    cells of one property may be given, or values would count more than once."""
    names = metrics.check(names)
    made = rollup.sums.groupBy(*by).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("double").alias({"bounce": "_bounce", "duration": "_duration"}.get(c, c)) for c in SUMS])
    if "visitors" in names:
        people = visitors(rollup.ids, by)
        made = made.join(people, by, "left").withColumn("visitors", F.coalesce("visitors", F.lit(0.0))) if by else made.crossJoin(people)  # two single rows
    return made.select(*by, *map(metrics.ratio, names))


def aggregate(rollup: Rollup, names: Iterable[str] = metrics.TOP, by: list[str] | None = None) -> DataFrame:
    return measure(rollup.where(F.col("prop") == ALL), by or [], names)


def timeseries(rollup: Rollup, interval: str, names: Iterable[str] = ("visitors",)) -> DataFrame:
    """One row for each bucket of ``interval`` with hits, as ``shapes.timeseries`` gives it."""
    rows = rollup.where(F.col("prop") == ALL)
    start = buckets.bucket(F.col("bucket"), interval)
    rows = Rollup(rows.sums.withColumn("bucket", start), rows.ids.withColumn("bucket", start))
    made = measure(rows, ["bucket"], names)
    return made.select(buckets.label(F.col("bucket"), interval).alias("timestamp"), *names).orderBy("timestamp")


def breakdown(rollup: Rollup, prop: str, names: Iterable[str] = ("visitors",), limit: int | None = None) -> DataFrame:
    """One row for each value of a property, most visitors first and ties by value."""
    name, names = filters.column(prop), list(names)
    made = measure(rollup.where(F.col("prop") == name), ["value"], dict.fromkeys([*names, "visitors"]))
    made = made.withColumn("value", F.col("value").cast("int")) if name == "city" else made
    made = made.orderBy(F.desc("visitors"), "value")
    made = made if limit is None else made.limit(limit)
    return made.select(F.col("value").alias(name), *names)


def write(rollup: Rollup, path: str, interval: str, load: str) -> None:
    """Adds a load to a stored rollup. A load that is written again replaces itself, so a retry adds nothing. Files lie
    by interval, site and month, and are sorted by property, so a reader of some values skips most row groups."""
    for name, df in (("sums", rollup.sums), ("ids", rollup.ids)):
        rows = df.withColumn("month", F.trunc("bucket", "month")).repartition("domain", "month", "prop").sortWithinPartitions("domain", "month", "prop", "bucket", "value")
        rows.write.mode("overwrite").partitionBy("domain", "month").parquet(f"{path}/{name}/interval={interval}/load={load}")


def read(spark: SparkSession, path: str, interval: str) -> Rollup:
    """All loads of one interval; give periods as bounds on ``bucket`` and on ``month``, which prunes folders."""
    def one(name: str) -> DataFrame:
        return spark.read.option("basePath", f"{path}/{name}").parquet(f"{path}/{name}/interval={interval}").drop("interval", "load")

    return Rollup(one("sums"), one("ids"))
