"""Dashboard reports: fixed parameters of the query shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import shown_referrer
from ..operators import lookups, shapes

DETAILS = ("visitors", "bounce_rate", "visit_duration")


def sources(hits: DataFrame, detailed: bool = False) -> DataFrame:
    return shapes.breakdown(hits, "source", DETAILS if detailed else ("visitors",))


def campaign(hits: DataFrame, which: str, detailed: bool = False) -> DataFrame:
    """utm_source, utm_medium, utm_campaign, utm_content or utm_term."""
    return shapes.breakdown(hits, which, DETAILS if detailed else ("visitors",))


def referrers(hits: DataFrame, source: str, detailed: bool = False) -> DataFrame:
    """Referrers of one source, shown without their scheme."""
    rows = hits.filter(F.col("source") == source).withColumn("referrer", shown_referrer(F.col("referrer")))
    return shapes.breakdown(rows, "referrer", DETAILS if detailed else ("visitors",))


def pages(hits: DataFrame, detailed: bool = False) -> DataFrame:
    return shapes.breakdown(hits, "page", ("visitors", "pageviews", "bounce_rate") if detailed else ("visitors",))


def entry_pages(hits: DataFrame) -> DataFrame:
    return shapes.breakdown(hits, "entry_page", ("visitors", "visits", "visit_duration"))


def countries(hits: DataFrame, names: DataFrame) -> DataFrame:
    """Visitors by country with what ``names`` (country, alpha3, name) knows of it; the code itself where it knows nothing.
    With two-letter codes (alpha2) in ``names`` also the flag."""
    made = shapes.breakdown(hits, "country")
    flagged = "alpha2" in names.columns
    out = lookups.lookup(made, names, "country", "country", {"alpha3": "alpha3", "name": "name"} | ({"alpha2": "flag"} if flagged else {}))
    out = out.withColumn("name", F.coalesce("name", "country"))
    return out.withColumn("flag", lookups.flag(F.col("flag"))) if flagged else out


def regions(hits: DataFrame, names: DataFrame) -> DataFrame:
    """Visitors by region with its name, country and flag from ``names`` (code, name, and the country's two letters as
    country); the code itself where there is no name."""
    out = lookups.lookup(shapes.breakdown(hits, "subdivision1_code"), names, "subdivision1_code", "code", {"name": "name", "country": "country"})
    return out.withColumns({"name": F.coalesce("name", "subdivision1_code"), "flag": lookups.flag(F.col("country"))})


def cities(hits: DataFrame, names: DataFrame) -> DataFrame:
    """Visitors by city with its name from ``names`` (city, name), N/A where there is none. With the country's two letters
    (alpha2) in ``names`` also the flag."""
    flagged = "alpha2" in names.columns
    out = lookups.lookup(shapes.breakdown(hits, "city"), names, "city", "city", {"name": "name"} | ({"alpha2": "flag"} if flagged else {}), {"name": "N/A"})
    return out.withColumn("flag", lookups.flag(F.col("flag"))) if flagged else out


def main_graph(hits: DataFrame, interval: str, metric: str = "visitors") -> DataFrame:
    """One row: labels and plot, arrays in order of time. Its length is the number of buckets of the period."""
    made = shapes.timeseries(hits, interval, [metric])
    both = F.sort_array(F.collect_list(F.struct("timestamp", metric)))
    return made.agg(both.alias("p")).select(F.col("p.timestamp").alias("labels"), F.col(f"p.{metric}").alias("plot"))


def seen_first(hits: DataFrame, sites: DataFrame) -> DataFrame:
    """Whether each site has any hit."""
    seen = hits.select("domain").distinct().withColumn("seen", F.lit(True))
    return sites.select("domain").join(seen, "domain", "left").select("domain", F.coalesce("seen", F.lit(False)).alias("seen"))
