"""The hit store: Parquet by site and day, so that a query's site and period prune files before they are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARTITIONS = ["domain", "day"]


def write(hits: DataFrame, path: str, mode: str = "append") -> None:
    """Adds hits. Rows are dealt by site, day and a salt of the visitor, so one busy site fills many files of even size
    and a quiet one few; inside a file they are sorted by time for the benefit of its statistics."""
    rows = hits.withColumn("day", F.to_date("ts"))
    rows = rows.repartition("domain", "day", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("domain", "day", "ts")
    rows.write.mode(mode).partitionBy(*PARTITIONS).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def of(hits: DataFrame, domain: str, first_day, last_day) -> DataFrame:
    """The hits of a site from one day to another; both conditions prune partitions."""
    return hits.filter((F.col("domain") == domain) & F.col("day").between(F.lit(first_day), F.lit(last_day)))
