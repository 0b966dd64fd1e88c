"""The table of sites with their goals (domain, public, goals), changed by plain transformations. Deleting a site leaves
its hits in the store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import clean_domain
from ..schema import SITE


def create(sites: DataFrame, domains: list[str]) -> DataFrame:
    """Adds sites under their cleaned names; names that are not valid and sites that exist already are left out."""
    new = sites.sparkSession.createDataFrame([(d,) for d in domains], "typed string").select(clean_domain(F.col("typed")).alias("domain")).filter("domain is not null").distinct()
    new = new.join(sites.select("domain"), "domain", "left_anti")
    goals = SITE.split("goals ")[1]
    return sites.unionByName(new.select("domain", F.lit(False).alias("public"), F.array().cast(goals).alias("goals")))


def delete(sites: DataFrame, domain: str) -> DataFrame:
    return sites.filter(F.col("domain") != domain)


def add_goal(sites: DataFrame, domain: str, name: str | None = None, path: str | None = None) -> DataFrame:
    """Adds an event goal or a page goal; one that is there already stays single."""
    if (name is None) == (path is None):
        raise ValueError("a goal is an event name or a page path")
    if path is not None and not path.startswith("/"):
        raise ValueError("a page path starts with /")
    goal = F.struct(F.lit(name).cast("string").alias("name"), F.lit(path).cast("string").alias("path"))
    return sites.withColumn("goals", F.when(F.col("domain") == domain, F.array_union("goals", F.array(goal))).otherwise(F.col("goals")))


def delete_goal(sites: DataFrame, domain: str, index: int) -> DataFrame:
    kept = F.filter("goals", lambda g, k: k != index)
    return sites.withColumn("goals", F.when(F.col("domain") == domain, kept).otherwise(F.col("goals")))


def goals(sites: DataFrame) -> DataFrame:
    """One row (domain, name, path) for each goal."""
    return sites.select("domain", F.explode("goals").alias("g")).select("domain", "g.name", "g.path")
