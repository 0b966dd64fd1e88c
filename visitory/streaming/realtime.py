"""Visitors of the last minutes, for every minute, exact: a stream keeps the set of visitors of each minute, and the figure
of a minute unites the sets of the minutes before it.

A set is a bitmap for each 32,768 visitor numbers. The stream holds each minute once, until the watermark passes it, and
hands on those that a micro-batch has changed; a sliding window would hold every hit in as many windows as it has steps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MINUTE = "1 minute"


def sets(hits: DataFrame, late: str = "10 minutes") -> DataFrame:
    """(domain, minute, chunk, visitors: bitmap, pageviews) of hits at most ``late`` behind; on a stream in update mode."""
    timed = hits.filter("domain is not null and id is not null").withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    made = timed.groupBy("domain", F.window("at", MINUTE), F.bitmap_bucket_number("id").alias("chunk"))
    made = made.agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("visitors"), F.count_if("view").alias("pageviews"))
    return made.select("domain", F.col("window.start").cast("timestamp_ntz").alias("minute"), "chunk", "visitors", "pageviews")


def keep(stream: DataFrame, path: str, checkpoint: str, every: str | None = "10 seconds"):
    """Starts storing the sets as they change. A batch has a folder of its number, which a repeated batch replaces."""

    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return stream.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**({"processingTime": every} if every else {"availableNow": True})).start()


def read(spark: SparkSession, path: str) -> DataFrame:
    """The sets as they were last stored: of each minute and chunk the row of the latest batch."""
    rows = spark.read.parquet(path)
    latest = F.max_by(F.struct("visitors", "pageviews"), "batch").alias("last")
    return rows.groupBy("domain", "minute", "chunk").agg(latest).select("domain", "minute", "chunk", "last.*")


def figures(minutes: DataFrame, last: int = 5) -> DataFrame:
    """(domain, minute, visitors, pageviews) of the ``last`` minutes up to each minute, this one included, for every minute
    in which any of them has hits. Bitmaps are united in groups of one site, minute and chunk."""
    ends = minutes.select("domain", "chunk", "visitors", "pageviews", F.explode(F.transform(F.sequence(F.lit(0), F.lit(last - 1)), lambda k: F.col("minute") + F.make_dt_interval(mins=k))).alias("minute"))
    united = ends.groupBy("domain", "minute", "chunk").agg(F.bitmap_count(F.bitmap_or_agg("visitors")).alias("n"), F.sum("pageviews").alias("pageviews"))
    return united.groupBy("domain", "minute").agg(F.sum("n").cast("double").alias("visitors"), F.sum("pageviews").cast("double").alias("pageviews"))
