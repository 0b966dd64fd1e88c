"""Hits from tracker payloads: JSON, validation, enrichment. Row by row but for joins with tables at rest (sites, address
ranges, source names), so it runs the same on a batch and on a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import agent, scalar
from ..operators import lookups
from ..schema import PAYLOAD
from . import agents

NAME_LENGTH = 120


def read(spark: SparkSession, path: str) -> DataFrame:
    """Payload files, one JSON object a line; lines that do not parse come out as rows of nulls and fail validation."""
    return spark.read.schema(PAYLOAD).json(path)


def stream(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The same as a stream of the files that arrive in a folder."""
    return spark.readStream.schema(PAYLOAD).options(**options).json(path)


def from_text(rows: DataFrame, column: str) -> DataFrame:
    """Payloads in a text column."""
    return rows.select(F.inline(F.array(F.from_json(F.col(column), PAYLOAD))))


def parsed(raw: DataFrame) -> DataFrame:
    """Payloads with short and long names brought together: name, url, domain, referrer, ts, host, page, query parts.
    The client's address is taken from ``headers`` where they name it. Custom properties and revenue are not stored."""
    url = scalar.first_filled(F.col("u"), F.col("url"))
    rows = scalar.once(
        raw,
        scalar.first_filled(F.col("n"), F.col("name")).alias("name"),
        url.alias("url"),
        scalar.first_domain(scalar.first_filled(F.col("d"), F.col("domain"))).alias("domain"),
        scalar.clean_referrer(scalar.first_filled(F.col("r"), F.col("referrer"))).alias("referrer"),
        F.coalesce("h", "hashMode").alias("hash_mode"),
        F.coalesce(F.timestamp_seconds(F.floor(F.col("ts") / 1000)).cast("timestamp_ntz"), F.col("received_at")).alias("ts"),
        scalar.client_address(F.col("headers"), F.col("remote_ip")).alias("remote_ip"),
        "user_agent",
    )
    parts = {"full_host": "HOST", "_path": "PATH", "_fragment": "REF", "_query": "QUERY"}
    names = rows.columns
    rows = scalar.once(rows, *names, *[scalar.url_part(F.col("url"), part).alias(c) for c, part in parts.items()])
    query = {k: scalar.query_value(F.col("_query"), k) for k in ("utm_source", "utm_medium", "utm_campaign", "utm_content", "utm_term", "source", "ref")}
    return scalar.once(
        rows,
        *names,
        "full_host",
        scalar.page_of(F.col("full_host"), F.col("_path"), F.col("_fragment"), F.col("hash_mode")).alias("page"),
        *[v.alias(f"q_{k}") for k, v in query.items()],
        scalar.clean_host(F.col("full_host")).alias("host"),
    )


def fault(rows: DataFrame) -> Column:
    """Why a parsed payload is refused; null if it is fine."""
    return (
        F.when(F.col("name").isNull(), "no name")
        .when(F.octet_length("name") > NAME_LENGTH, "long name")
        .when(F.coalesce(F.lower("url").startswith("data:"), F.lit(False)), "data url")
        .when(F.col("domain").isNull(), "no domain")
        .when(F.coalesce(F.col("host"), F.lit("")) == "", "no host")
        .when(F.col("page").isNull(), "no path")
        .when(F.col("ts").isNull(), "no time")
    )


def split(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid parsed payloads, and the refused ones with ``fault``."""
    rows = parsed(raw)
    rows = rows.withColumn("fault", fault(rows))
    return rows.filter("fault is null").drop("fault"), rows.filter("fault is not null")


def enriched(valid: DataFrame, sites: DataFrame, ranges: DataFrame, known_agents: DataFrame | None = None) -> DataFrame:
    """Hits of known sites from people: visitor id, view or event, agent, place, source. ``seq`` breaks ties of time. Agents
    are parsed row by row, or taken from the table ``known_agents`` (see :mod:`.agents`)."""
    rows = lookups.known_sites(valid, sites)
    rows = agent.parsed(rows) if known_agents is None else agents.with_agents(rows, known_agents)
    rows = rows.filter("not bot").drop("bot")
    rows = lookups.with_place(rows, ranges)
    rows = lookups.with_source(rows, "referrer", {"a": F.col("q_utm_source"), "b": F.col("q_source"), "c": F.col("q_ref")})
    view = F.col("name") == "pageview"
    visitor = scalar.visitor_id(F.col("remote_ip"), F.col("user_agent"), F.col("domain"), F.col("host"))
    return rows.select(
        "domain", visitor.alias("id"), F.xxhash64("name", "url", "referrer").alias("seq"), "ts",
        view.alias("view"), F.when(~view, F.col("name")).alias("event"), "page", "host",
        "browser", "browser_version", "os", "os_version", "device", "country", "subdivision1_code", "city", "source", "referrer",
        F.col("q_utm_campaign").alias("utm_campaign"), F.col("q_utm_content").alias("utm_content"), F.col("q_utm_medium").alias("utm_medium"),
        F.col("q_utm_source").alias("utm_source"), F.col("q_utm_term").alias("utm_term"),
    )
