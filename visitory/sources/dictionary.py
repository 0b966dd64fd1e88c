"""The values of each property that a site has had, kept up by loads: suggestions and first sightings read it alone.

A row for each site, property and value with the time of its first hit. A load's values are made distinct before they
move, and only the folders (property and site) with a new value or an earlier time are written anew; a load that comes
again changes nothing. Files are ranges of values in order, so a prefix reads the files, and the row groups in them,
whose bounds hold it.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import filters
from ..schema import PROPERTIES
from . import upkeep, work

#: The property whose one value, the empty text, stands for the site itself.
SITE = "site"


def _values(hits: DataFrame, props: Iterable[str]) -> DataFrame:
    pairs = [F.struct(F.lit(p).alias("prop"), F.col(filters.column(p)).cast("string").alias("value")) for p in props]
    cells = hits.select("domain", "ts", F.explode(F.array(F.struct(F.lit(SITE).alias("prop"), F.lit("").alias("value")), *pairs)).alias("c"))
    cells = cells.filter("domain is not null and c.value is not null")
    return cells.groupBy(F.col("c.prop").alias("prop"), "domain", F.col("c.value").alias("value")).agg(F.min("ts").alias("first"))


def grow(hits: DataFrame, path: str, props: Iterable[str] | None = None) -> None:
    """Adds a load of hits: the values of ``props``, or of all properties that the hits have."""
    spark = hits.sparkSession
    made = _values(hits, [p for p in PROPERTIES if p in hits.columns] if props is None else props)
    if upkeep._exists(spark, path):
        key = ["prop", "domain", "value"]
        made = work.written(made, "values")
        old = read(spark, path)
        was = old.withColumnRenamed("first", "was")
        changed = work.written(made.join(was, key, "left").filter("was is null or first < was").select("prop", "domain").distinct(), "changed-values")
        both = old.unionByName(made).join(changed, ["prop", "domain"], "left_semi")
        made = both.groupBy(*key).agg(F.min("first").alias("first"))
    rows = made.repartitionByRange("prop", "domain", "value").sortWithinPartitions("prop", "domain", "value")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("prop", "domain").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """prop, domain, value, first."""
    return spark.read.schema("value string, first timestamp_ntz, prop string, domain string").parquet(path)


def values(known: DataFrame, domain: str, prop: str, prefix: str = "", names: DataFrame | None = None) -> DataFrame:
    """A site's values of a property in byte order, as value and label, as ``shapes.distinct_values`` gives them."""
    rows = known.filter((F.col("prop") == filters.column(prop)) & (F.col("domain") == domain))
    if prefix:
        rows = rows.filter(F.col("value").startswith(prefix))
    if names is None:
        return rows.select("value", F.col("value").alias("label")).orderBy("value")
    labels = names.select("value", "label").dropDuplicates(["value"])
    return rows.select("value").join(labels, "value", "left").select("value", F.coalesce("label", "value").alias("label")).orderBy("value")


def seen_first(known: DataFrame, sites: DataFrame) -> DataFrame:
    """Whether each site has had any hit, as ``reports.seen_first`` gives it."""
    seen = known.filter(F.col("prop") == SITE).select("domain", F.lit(True).alias("seen"))
    return sites.select("domain").join(seen, "domain", "left").select("domain", F.coalesce("seen", F.lit(False)).alias("seen"))
