"""A table of user agents: each different string is parsed once, when it is first seen, and hits meet it by a join.

The table grows by loads. A load's strings are made distinct, those that the table has are left out by an anti-join, and
the rest are parsed and appended, so a string costs its regular expressions once, however many hits carry it. The join is
on a 64-bit hash with the string compared behind it. Strings that two loads bring at once may be in the table twice with
equal values; readers take each once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import agent
from . import upkeep, work

PARSED = ["browser", "browser_version", "os", "os_version", "device", "bot"]


def _hashed(strings: DataFrame) -> DataFrame:
    return strings.select(F.xxhash64("user_agent").alias("agent_hash"), "user_agent")


def read(spark: SparkSession, path: str) -> DataFrame:
    """agent_hash, user_agent and what is parsed from it, one row for each string."""
    return spark.read.parquet(path).dropDuplicates(["agent_hash", "user_agent"])


def grow(rows: DataFrame, path: str) -> int:
    """Adds the strings of ``rows`` (user_agent; null ones have no row) that the table lacks. Returns how many were parsed."""
    spark = rows.sparkSession
    new = _hashed(rows.select("user_agent").filter("user_agent is not null").distinct())
    if upkeep._exists(spark, path):
        new = new.join(spark.read.parquet(path).select("agent_hash", "user_agent"), ["agent_hash", "user_agent"], "left_anti")
    made = work.written(agent.parsed(new), "new-agents")
    n = made.count()
    if n or not upkeep._exists(spark, path):
        made.select("agent_hash", "user_agent", *PARSED).write.mode("append").parquet(path)
    return n


def with_agents(rows: DataFrame, known: DataFrame) -> DataFrame:
    """``rows`` (user_agent and others) with what the table ``known`` has parsed, as :func:`agent.parsed` gives it. Works on
    a stream too, the table being joined as it is when the stream's batch starts; rows whose string is not in it keep
    nulls and are taken for people, as are those without one."""
    hashed = rows.withColumn("_hash", F.xxhash64("user_agent"))
    small = known.select(F.col("agent_hash").alias("_known"), F.col("user_agent").alias("_string"), *PARSED)
    met = hashed.join(small, (F.col("_hash") == F.col("_known")) & (F.col("user_agent") == F.col("_string")), "left")
    return met.withColumn("bot", F.coalesce("bot", F.lit(False))).drop("_hash", "_known", "_string")
