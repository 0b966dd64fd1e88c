"""Hits derived from the ``events`` table, and site and goal tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The dense clock runs 48 times as fast from here, so that a visitor's hits fall within visits.
ORIGIN = 1704067200000000
DENSE = 48


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(key: Column, *names: str | None) -> Column:
    """The name at place ``key``, null beyond the last."""
    out = F.lit(None).cast("string")
    for k, name in enumerate(names):
        if name is not None:
            out = F.when(key == k, F.lit(name)).otherwise(out)
    return out


def dense(ts: Column) -> Column:
    micros = F.unix_micros(ts.cast("timestamp"))
    return F.timestamp_micros(F.lit(ORIGIN) + F.floor((micros - ORIGIN) / F.lit(DENSE)).cast("long")).cast("timestamp_ntz")


def hits(spark: SparkSession, sf_dir: str, clock: str = "dense") -> DataFrame:
    """One hit per row of ``events``; clock is ``dense`` or ``raw``."""
    nation = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    nation = nation.select(F.col("n_nationkey").alias("nation"), F.col("n_name").alias("country"), F.col("r_name").alias("subdivision1_code"))
    user, event = F.col("user_id"), F.col("event_id")
    referrer = _pick(event % 5, "https://google.com", "https://news.example.org/a", "http://t.co")
    utm_source = _pick(event % 6, "Twitter", "Facebook", "newsletter")
    browser, system = _pick(user % 5, "Chrome", "Firefox", "Safari", "Edge"), _pick(user % 4, "Windows", "macOS", "Linux")
    view = F.col("event_type") == "view"
    made = table(spark, sf_dir, "events").select(
        F.concat(F.lit("site"), (user % 3).cast("string"), F.lit(".example.com")).alias("domain"),
        user.alias("id"),
        event.alias("seq"),
        (F.col("ts") if clock == "raw" else dense(F.col("ts"))).alias("ts"),
        view.alias("view"),
        F.when(~view, F.col("event_type")).alias("event"),
        F.concat(F.lit("/p/"), (F.get_json_object("props", "$.k").cast("int") % 12).cast("string")).alias("page"),
        F.concat(F.lit("www"), (user % 2).cast("string"), F.lit(".example.com")).alias("host"),
        browser.alias("browser"),
        F.concat(browser, F.lit(" "), (user % 7).cast("string")).alias("browser_version"),
        system.alias("os"),
        F.concat(system, F.lit(" "), (user % 3).cast("string")).alias("os_version"),
        _pick(F.floor(user / 3) % 3, "Desktop", "Mobile", "Tablet").alias("device"),
        F.when((user * 7) % 40 != 0, (user * 7) % 40).cast("int").alias("city"),
        F.coalesce(utm_source, _pick(event % 5, "Google", "news.example.org", "Twitter")).alias("source"),
        referrer.alias("referrer"),
        _pick(event % 7, "spring", "launch").alias("utm_campaign"),
        _pick(event % 8, "a", "b").alias("utm_content"),
        _pick(event % 4, "social", "email").alias("utm_medium"),
        utm_source.alias("utm_source"),
        _pick(event % 9, "x", "y").alias("utm_term"),
        (user % 25).alias("_nation"),
    )
    return made.join(F.broadcast(nation), F.col("_nation") == F.col("nation"), "left").drop("_nation", "nation")


def goals(spark: SparkSession) -> DataFrame:
    """Goals of the three sites: two events and a page each. Fixed, a few rows."""
    rows = [(f"site{k}.example.com", name, path) for k in range(3) for name, path in (("signup", None), ("purchase", None), (None, "/p/3"))]
    return spark.createDataFrame(rows, "domain string, name string, path string")
