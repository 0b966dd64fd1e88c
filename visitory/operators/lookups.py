"""Lookups in small tables: left outer joins on a key, and a range join for addresses.

A side is broadcast only by Spark's own choice, after its size; none is hinted here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType
from pyspark.sql.window import Window

from ..functions.scalar import address_number, once, url_part

#: Parts that a site's hits are dealt over.
SALTS = 64
#: Known referrer hosts and the names shown for them. Fixed values.
SOURCES = {
    "google.com": "Google", "bing.com": "Bing", "duckduckgo.com": "DuckDuckGo", "t.co": "Twitter", "twitter.com": "Twitter", "x.com": "Twitter",
    "facebook.com": "Facebook", "l.facebook.com": "Facebook", "linkedin.com": "LinkedIn", "lnkd.in": "LinkedIn", "reddit.com": "Reddit",
    "news.ycombinator.com": "Hacker News", "github.com": "GitHub", "youtube.com": "YouTube", "mail.126.com": "126 Mail",
}


def lookup(rows: DataFrame, names: DataFrame, key: str, name_key: str, take: dict[str, str], missing: dict[str, str] | None = None) -> DataFrame:
    """``rows`` with columns of ``names`` (``take``: theirs to new names) where ``key`` equals ``name_key``; rows without
    a match keep null, or the value in ``missing``. ``names`` counts once for each key."""
    small = names.select(F.col(name_key).alias("_key"), *[F.col(a).alias(b) for a, b in take.items()]).dropDuplicates(["_key"])
    out = rows.join(small, F.col(key) == F.col("_key"), "left").drop("_key")
    for column, value in (missing or {}).items():
        out = out.withColumn(column, F.coalesce(column, F.lit(value)))
    return out


def with_city_id(rows: DataFrame, cities: DataFrame, country_col: str = "country", city_col: str = "city_name") -> DataFrame:
    """``rows`` with ``city``, the id of the city of that name in that country in ``cities`` (country, name, city)."""
    small = cities.select(F.col("country").alias("_country"), F.col("name").alias("_city"), "city").dropDuplicates(["_country", "_city"])
    return rows.join(small, (F.col(country_col) == F.col("_country")) & (F.col(city_col) == F.col("_city")), "left").drop("_country", "_city")


def with_region(rows: DataFrame, names: DataFrame, code_col: str = "subdivision1_code") -> DataFrame:
    """``rows`` with ``region``, the name of the region code in ``names`` (code, name); the code itself where it is unknown."""
    out = lookup(rows, names, code_col, "code", {"name": "region"})
    return out.withColumn("region", F.coalesce("region", code_col))


def flag(alpha2: Column) -> Column:
    """The flag of a two-letter country code: its letters as regional indicators."""
    def sign(k: int) -> Column:
        code = F.ascii(F.substring(F.upper(alpha2), k, 1)) - 65
        # U+1F1E6 and on, in UTF-8: F0 9F 87 A6
        return F.concat(F.lit("F09F87"), F.hex(code + 0xA6))

    return F.when(alpha2.rlike("^[A-Za-z]{2}$"), F.decode(F.unhex(F.concat(sign(1), sign(2))), "UTF-8"))


def source_names(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SOURCES.items()), "host string, name string")


def with_source(rows: DataFrame, referrer_col: str = "referrer", query: dict[str, str] | None = None) -> DataFrame:
    """``rows`` with ``source``: the first filled of utm_source, source and ref (the columns named in ``query``), the
    known name of the referrer's host, that host."""
    host = F.regexp_replace(url_part(F.col(referrer_col), "HOST"), r"^www\.", "")
    out = lookup(once(rows, *rows.columns, host.alias("_host")), source_names(rows.sparkSession), "_host", "host", {"name": "_name"})
    given = [F.nullif(F.trim(c), F.lit("")) for c in (query or {}).values()]
    return out.withColumn("source", F.coalesce(*given, "_name", "_host")).drop("_host", "_name")


def disjoint(ranges: DataFrame) -> DataFrame:
    """Address ranges (low, high, country, subdivision1_code, city), which may lie inside each other, as pieces that do
    not: (block, low, high, place), each with the place of the narrowest range around it. No piece goes over a /16 block."""
    spread = ranges.withColumn("block", F.explode(F.sequence(F.floor(F.col("low") / 65536), F.floor(F.col("high") / 65536))))
    first, last = F.greatest("low", F.col("block") * 65536), F.least("high", F.col("block") * 65536 + 65535)
    spread = spread.select("block", first.alias("from"), last.alias("to"), (F.col("high") - F.col("low")).alias("width"), F.col("low").alias("start"), F.struct("country", "subdivision1_code", "city").alias("place"))
    edges = spread.select("block", F.col("from").alias("low")).union(spread.select("block", F.col("to") + 1)).distinct()
    edges = edges.withColumn("high", F.lead("low").over(Window.partitionBy("block").orderBy("low")) - 1).filter("high is not null")
    inside = edges.join(spread, "block").filter((F.col("from") <= F.col("low")) & (F.col("to") >= F.col("high")))
    return inside.groupBy("block", "low", "high").agg(F.min_by("place", F.struct("width", "start")).alias("place"))


def with_place(rows: DataFrame, ranges: DataFrame, address_col: str = "remote_ip") -> DataFrame:
    """``rows`` with country, subdivision1_code and city of the narrowest range (low, high, country, subdivision1_code,
    city) that holds the address.

    The ranges are cut into disjoint pieces first, so each row meets at most one: one join on the /16 block of the
    address with the bounds checked behind it, and no shuffle of rows if Spark finds the pieces small enough to send.
    """
    pieces = disjoint(ranges).select(F.col("block").alias("_block"), F.col("low").alias("_low"), F.col("high").alias("_high"), "place")
    known = once(rows, *rows.columns, address_number(F.col(address_col)).alias("_ip"))
    met = known.join(pieces, (F.floor(F.col("_ip") / 65536) == F.col("_block")) & F.col("_ip").between(F.col("_low"), F.col("_high")), "left")
    return met.select(*rows.columns, "place.country", "place.subdivision1_code", "place.city")


def known_sites(hits: DataFrame, sites: DataFrame) -> DataFrame:
    """The hits of known sites. A site's hits are dealt over :data:`SALTS` parts by what they hold and meet a copy of the site
    in each, so a few sites with most of the hits keep all tasks busy."""
    flat = [f.name for f in hits.schema.fields if isinstance(f.dataType, AtomicType)]
    salted = hits.withColumn("_salt", F.pmod(F.xxhash64(*flat), F.lit(SALTS)))
    known = sites.select("domain").distinct().withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(known, ["domain", "_salt"], "left_semi").drop("_salt")
