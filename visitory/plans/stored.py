"""Registered queries over what is stored and streamed: rollups in several loads, visits kept up over loads, settled
streams, visits by pointers. Each equals a query over the hits themselves and has its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import periods, scalar
from ..operators import lookups, metrics, places, rollup, shapes, visits
from ..sources import agents, compaction, dictionary, payload, sites, tables, upkeep, work
from ..sources import store as hit_store
from ..streaming import realtime, settled
from . import api, catalog, reports
from .catalog import NOW_RAW, ORACLE_SQL, QUERIES, hits, register, visited

__all__ = ["ORACLE_SQL", "QUERIES"]  # the catalogue's, with these queries added

# Rollups


def _rollup(spark: SparkSession, sf_dir: str, interval: str, props=(), clock: str = "dense") -> rollup.Rollup:
    """A stored rollup of two loads that share sites, buckets and visitors, made by the hour where ``interval`` allows."""
    rows = work.written(visited(spark, sf_dir, clock), "visits")
    path = work.folder(spark, "rollup")
    for k in range(2):
        made = rollup.of(rows.filter(F.col("seq") % 2 == k), "minute" if interval == "minute" else "hour", props)
        rollup.write(made if interval in ("minute", "hour") else rollup.merged(made, interval), path, interval, f"load{k}")
    return rollup.read(spark, path, interval)


register("rollup_agg_all", ORACLE_SQL["agg_all"])(lambda s, d: rollup.aggregate(_rollup(s, d, "month"), metrics.NAMES))
register("rollup_agg_per_site", ORACLE_SQL["agg_per_site"])(lambda s, d: rollup.aggregate(rollup.merged(_rollup(s, d, "hour")), metrics.NAMES, ["domain"]))
for _i, _stored, _clock in (("minute", "minute", "dense"), ("hour", "hour", "dense"), ("date", "hour", "raw"), ("week", "date", "raw"), ("month", "date", "raw")):
    register(f"rollup_ts_{_i}", ORACLE_SQL[f"ts_{_i}"])(lambda s, d, i=_i, x=_stored, c=_clock: rollup.timeseries(_rollup(s, d, x, clock=c), i, metrics.NAMES))
for _prop in ("page", "entry_page", "exit_page", "event", "source", "browser", "country", "city"):
    register(f"rollup_bd_{_prop}", ORACLE_SQL[f"bd_{_prop}"])(lambda s, d, p=_prop: rollup.breakdown(_rollup(s, d, "date", [p]), p, metrics.NAMES))
for _name in ("7d", "month", "6mo"):
    _period = periods.period(*(catalog._PERIODS[_name][0], NOW_RAW, catalog._PERIODS[_name][1]))

    def _of_period(spark: SparkSession, sf_dir: str, p: periods.Period = _period) -> DataFrame:
        """A period of whole days from days alone."""
        first, after = periods.truncated(p.start, p.interval), periods.following(periods.truncated(p.end, p.interval), p.interval)
        days = (F.col("bucket") >= F.lit(first)) & (F.col("bucket") < F.lit(after)) & (F.col("month") >= F.trunc(F.lit(first), "month")) & (F.col("month") <= F.lit(after.date()))
        return rollup.aggregate(_rollup(spark, sf_dir, "date", clock="raw").where(days), metrics.NAMES, ["domain"])

    register(f"rollup_period_{_name}", ORACLE_SQL[f"period_{_name}"])(_of_period)

# Visits kept up over three loads, the last of which is late by any time

_STORES: dict[tuple[str, str, str], str] = {}


def store(spark: SparkSession, sf_dir: str, clock: str = "dense") -> DataFrame:
    """Stored visits; made once a session, as a store would be."""
    at = (spark.sparkContext.applicationId, sf_dir, clock)
    if at not in _STORES or not upkeep._exists(spark, _STORES[at]):
        rows = hits(spark, sf_dir, clock)
        span = rows.agg(F.min("ts").alias("low"), F.max("ts").alias("high")).first()
        path, late = work.folder(spark, "store"), F.col("seq") % 13 == 0
        if span["low"] is not None:
            middle = F.lit(span["low"] + (span["high"] - span["low"]) / 2)
            loads = (rows.filter(~late & (F.col("ts") < middle)), rows.filter(~late & (F.col("ts") >= middle)), rows.filter(late))
        else:
            loads = (rows,)
        for load in loads:
            upkeep.add(load, path)
        _STORES[at] = path
    return upkeep.read(spark, _STORES[at])


_VISIT = "domain, id, seq, visit_start, session, bounce, duration, entry_page, exit_page, true_exit_page, host"
register("stored_visits", ORACLE_SQL["visits_dense"])(lambda s, d: store(s, d).select(*_VISIT.split(", ")))
register("stored_agg_all", ORACLE_SQL["agg_all"])(lambda s, d: shapes.aggregate(store(s, d), metrics.NAMES))
register("stored_ts_hour", ORACLE_SQL["ts_hour"])(lambda s, d: shapes.timeseries(store(s, d), "hour", metrics.NAMES))
register("stored_exit_pages", ORACLE_SQL["exit_pages"])(lambda s, d: shapes.exit_pages(store(s, d)))
register("stored_report_pages", ORACLE_SQL["report_pages"])(lambda s, d: reports.pages(store(s, d), True))
register("stored_report_entry_pages", ORACLE_SQL["report_entry_pages"])(lambda s, d: reports.entry_pages(store(s, d)))
register("stored_report_sources", ORACLE_SQL["report_sources"])(lambda s, d: reports.sources(store(s, d), True))
for _prop in ("page", "browser", "country"):
    register(f"stored_bd_{_prop}", ORACLE_SQL[f"bd_{_prop}"])(lambda s, d, p=_prop: shapes.breakdown(store(s, d), p, metrics.NAMES))
for _name in ("entry_page", "json"):
    register(f"stored_filter_{_name}", ORACLE_SQL[f"filter_{_name}"])(lambda s, d, w=catalog._FILTERS[_name][0]: metrics.measure(shapes.select(store(s, d), where=w), ["domain"], metrics.NAMES))
for _name in ("day", "7d", "month"):
    _period = periods.period(catalog._PERIODS[_name][0], NOW_RAW, catalog._PERIODS[_name][1])
    register(f"stored_period_{_name}", ORACLE_SQL[f"period_{_name}"])(lambda s, d, p=_period: metrics.measure(shapes.select(store(s, d, "raw"), period=p), ["domain"], metrics.NAMES))
register("stored_top_stats_prev", ORACLE_SQL["top_stats_prev"])(lambda s, d: shapes.top_stats(store(s, d, "raw"), None, catalog._week, "previous_period", NOW_RAW, by=["domain"]))

# Visits by pointers in all stretches of more than two instants

register("visits_pointers", ORACLE_SQL["visits_dense"])(lambda s, d: visits.visits(hits(s, d), most=2).select(*_VISIT.split(", ")))

# A stream whose hits come up to half an hour out of order, and some twice


def streamed(spark: SparkSession, sf_dir: str, files: int = 4) -> DataFrame:
    """The settled visits of all hits, which arrive in ``files`` parts by time and a delay that each hit has of its own."""
    rows = hits(spark, sf_dir)
    arrival = F.unix_micros(F.col("ts").cast("timestamp")) + F.pmod(F.xxhash64("seq"), F.lit(1_800_000_000))
    span = rows.agg(F.min(arrival).alias("low"), F.max(arrival).alias("high")).first()
    base = work.folder(spark, "stream")
    low, high = span["low"] or 0, span["high"] or 0
    step = (high - low) // files + 1
    settled.prepare(spark)
    rows.limit(0).write.parquet(base + "/in")
    made = settled.visits(spark.readStream.schema(rows.schema).parquet(base + "/in"), "40 minutes")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    def go_on(arrived: DataFrame) -> None:
        """What has arrived is one batch, of as many files as it has tasks; the stream goes on where it stood."""
        arrived.write.mode("append").parquet(base + "/in")
        made.writeStream.foreachBatch(put).option("checkpointLocation", base + "/state").trigger(availableNow=True).start().awaitTermination()

    for k in range(files):
        # what arrived in the last minute before comes again
        go_on(rows.filter((arrival >= low + k * step - 60_000_000) & (arrival < low + (k + 1) * step)))
    # a hit much later moves the watermark past the last visit
    end = {"domain": F.lit("~end"), "id": F.lit(0).cast("long"), "seq": F.lit(0).cast("long"), "ts": F.timestamp_micros(F.lit(high + 10**11)).cast("timestamp_ntz"), "view": F.lit(True)}
    go_on(spark.range(1).coalesce(1).select(*[end.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema.fields]))
    return spark.read.schema(made.schema).parquet(f"{base}/out/batch=*")


register("streamed_visits", ORACLE_SQL["visits_dense"])(lambda s, d: streamed(s, d).select(*_VISIT.split(", ")))
register("streamed_bd_source", ORACLE_SQL["bd_source"])(lambda s, d: shapes.breakdown(streamed(s, d), "source", metrics.NAMES))


# Dictionaries of values, grown by three loads


def _dictionary(spark: SparkSession, sf_dir: str, *props: str) -> DataFrame:
    path, rows = work.folder(spark, "dictionary"), hits(spark, sf_dir)
    for k in (0, 1, 1):  # the last load comes again
        dictionary.grow(rows.filter(F.col("seq") % 2 == k), path, props)
    return dictionary.read(spark, path)


for _prop in ("page", "country", "source"):
    register(f"dictionary_{_prop}", ORACLE_SQL[f"suggest_{_prop}"])(lambda s, d, p=_prop: dictionary.values(_dictionary(s, d, p), catalog.SITE, p))
register("dictionary_prefix", ORACLE_SQL["suggest_prefix"])(lambda s, d: dictionary.values(_dictionary(s, d, "page"), catalog.SITE, "page", "/p/1"))
register("dictionary_seen_first", ORACLE_SQL["report_seen_first"])(
    lambda s, d: dictionary.seen_first(_dictionary(s, d), tables.table(s, d, "nation").select(F.concat(F.lit("site"), F.col("n_nationkey").cast("string"), F.lit(".example.com")).alias("domain")))
)
register("dictionary_first", f"{catalog._with('dense', False)} SELECT domain, page AS value, min(ts) AS first FROM hits WHERE page IS NOT NULL GROUP BY domain, page")(
    lambda s, d: _dictionary(s, d, "page").filter("prop = 'page'").select("domain", "value", "first")
)

# Ingest with a table of agents that two loads have made


@register("ingest_known_agents", ORACLE_SQL["ingest_hits"])
def ingest_known_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid, _ = payload.split(payload.from_text(catalog.payloads(spark, sf_dir), "json"))
    valid, path = work.written(valid, "payloads"), work.folder(spark, "agents")
    for k in range(2):
        agents.grow(valid.filter(F.pmod(F.xxhash64("remote_ip"), F.lit(2)) == k), path)
    made = payload.enriched(valid, catalog._sites(spark), catalog._ranges(spark, sf_dir), agents.read(spark, path))
    return made.select("domain", "ts", "view", "event", "page", "host", "browser", "browser_version", "os", "os_version", "device", "country", "subdivision1_code", "city", "source", "referrer", "utm_source", "utm_medium")


# Places by a sweep over IPv4 and IPv6 addresses; every other event has an IPv6 address


@register("place_sweep", ORACLE_SQL["place_lookup"])
def place_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, inner = F.lower(F.hex(F.col("user_id") % 25)), (F.col("event_id") % 5).cast("string")
    four = F.concat_ws(".", F.lit("10"), (F.col("user_id") % 25).cast("string"), inner, F.lit("7"))
    address = F.when(F.col("event_id") % 2 == 0, four).otherwise(F.concat(F.lit("2001:db8:"), nation, F.lit(":"), inner, F.lit("::7")))
    rows = tables.table(spark, sf_dir, "events").select("event_id", address.alias("remote_ip"))
    n = tables.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("d"), F.lower(F.hex("n_nationkey")).alias("h"), F.col("n_name").alias("country"))
    parts = [("10.{d}.0.0", "10.{d}.255.255", None, None), ("10.{d}.2.0", "10.{d}.2.255", "inner", 9)]
    parts += [("2001:db8:{h}::", "2001:db8:{h}:ffff:ffff:ffff:ffff:ffff", None, None), ("2001:db8:{h}:2::", "2001:db8:{h}:2:ffff:ffff:ffff:ffff", "inner", 9)]

    def text(pattern: str) -> Column:
        return F.replace(F.replace(F.lit(pattern), F.lit("{d}"), F.col("d")), F.lit("{h}"), F.col("h"))

    made = [n.select(text(a).alias("low"), text(b).alias("high"), "country", F.lit(r).cast("string").alias("subdivision1_code"), F.lit(c).cast("int").alias("city")) for a, b, r, c in parts]
    everywhere = spark.range(1).select(F.lit("::").alias("low"), F.lit("ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff").alias("high"), F.lit("nowhere").alias("country"), F.lit(None).cast("string").alias("subdivision1_code"), F.lit(None).cast("int").alias("city"))
    ranges = everywhere
    for m in made:
        ranges = ranges.unionByName(m)
    return places.with_place(rows, ranges).select("event_id", "country", "subdivision1_code", "city")


# Realtime figures of every minute, from a stream


@register(
    "streamed_realtime",
    f"""{catalog._with("dense", False)} SELECT domain, date_trunc('minute', ts) + k * INTERVAL 1 MINUTE AS minute, CAST(count(DISTINCT id) AS DOUBLE) AS visitors,
  CAST(count(*) FILTER (WHERE view) AS DOUBLE) AS pageviews FROM hits, (SELECT unnest(range(0, 5)) AS k) GROUP BY 1, 2""",
)
def streamed_realtime(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, base = hits(spark, sf_dir), work.folder(spark, "realtime")
    span = rows.agg(F.min("ts").alias("low"), F.max("ts").alias("high")).first()
    for k in range(3):
        if span["low"] is None:
            rows.write.mode("append").parquet(base + "/in")
        else:
            step = (span["high"] - span["low"]) / 3
            here = F.col("ts") >= F.lit(span["low"] + k * step) if k else F.lit(True)
            rows.filter(here & (F.col("ts") < F.lit(span["low"] + (k + 1) * step)) if k < 2 else here).coalesce(1).write.mode("append").parquet(base + "/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(base + "/in")
    realtime.keep(realtime.sets(stream), base + "/sets", base + "/state", None).awaitTermination()
    return realtime.figures(realtime.read(spark, base + "/sets"))


# The stats API over plain hits: visits are worked out only where they are needed

_WEEK = catalog._bounds(catalog._week)
_OF_SITE = f"domain = '{catalog.SITE}' AND {_WEEK}"


def _api(name: str, sql: str, call) -> None:
    register(name, f"{catalog._with('raw')} {sql}")(lambda s, d: call(hits(s, d, "raw")))


_api("api_aggregate_plain", catalog._measured("visits", {}, ["visitors", "pageviews"], _OF_SITE), lambda h: api.aggregate(h, catalog.SITE, NOW_RAW, "7d", "2024-01-15", metrics="visitors,pageviews"))
_api("api_aggregate", catalog._measured("visits", {}, metrics.NAMES, f"{_OF_SITE} AND entry_page = '/p/5'"), lambda h: api.aggregate(h, catalog.SITE, NOW_RAW, "7d", "2024-01-15", filters='[["is", "visit:entry_page", ["/p/5"]]]', metrics=",".join(metrics.NAMES)))
_api(
    "api_timeseries_week",
    catalog._measured("visits", {"timestamp": f"strftime({catalog._BUCKET['week']}, '%Y-%m-%d')"}, ["visitors", "visits"], f"domain = '{catalog.SITE}' AND {catalog._bounds(periods.period('custom', NOW_RAW, '2024-01-03,2024-01-24', 'week'))}"),
    lambda h: api.timeseries(h, catalog.SITE, NOW_RAW, **api.between("2024-01-03", "2024-01-24"), interval="week", metrics="visitors,visits"),
)
_api("api_breakdown", catalog._measured("visits", {"browser": "browser"}, ["visitors", "bounce_rate"], f"{_OF_SITE} AND browser IS NOT NULL"), lambda h: api.breakdown(h, catalog.SITE, "visit:browser", NOW_RAW, "7d", "2024-01-15", metrics="visitors,bounce_rate"))

# Cities with their country's flag, and ids of cities by name

register(
    "report_city_flags",
    f"{catalog._with('dense')}, g AS ({catalog._measured('visits', {'city': 'city'}, ['visitors'], 'city IS NOT NULL')}) SELECT city, visitors, coalesce(n_name, 'N/A') AS name, {catalog._FLAG.format(c='substr(n_name, 1, 2)')} AS flag FROM g LEFT JOIN nation ON n_nationkey = city",
)(lambda s, d: reports.cities(hits(s, d), tables.table(s, d, "nation").select(F.col("n_nationkey").alias("city"), F.col("n_name").alias("name"), F.substring("n_name", 1, 2).alias("alpha2"))))
register("city_ids", "SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN n_nationkey END AS city FROM customer JOIN nation ON n_nationkey = c_nationkey")(
    lambda s, d: lookups.with_city_id(
        tables.table(s, d, "customer").join(tables.table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, "nowhere").otherwise(F.col("n_name")).alias("city_name"), F.col("n_regionkey").cast("string").alias("country")),
        tables.table(s, d, "nation").select(F.col("n_regionkey").cast("string").alias("country"), F.col("n_name").alias("name"), F.col("n_nationkey").alias("city")),
    ).select("c_custkey", "city")
)

# Visits stored in many batches, of which all but the last two were compacted, in two goes


@register("compacted_visits", ORACLE_SQL["visits_dense"])
def compacted_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, path = work.written(visited(spark, sf_dir), "visits"), work.folder(spark, "batches")
    schema = rows.withColumn("day", F.to_date("ts")).schema
    for n in range(8):
        hit_store.write(rows.filter(F.pmod(F.xxhash64("seq"), F.lit(8)) == n), f"{path}/batch={n}", "overwrite")
        if n in (2, 5):
            compaction.compact(spark, path, schema)
    compaction.clean(spark, path)
    return compaction.read(spark, path, schema).select(*_VISIT.split(", "))

# Parts of ingest by themselves, over values made from events

_BYTES = "list_transform(regexp_extract_all(hex(encode({s})), '..'), lambda h: CAST('0x' || h AS BIGINT))"
_CRC32 = f"xor(list_reduce(list_prepend(4294967295, {_BYTES}), lambda c, b: list_reduce([xor(c, b), 1, 2, 3, 4, 5, 6, 7, 8], lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"


def _e(n: int) -> Column:
    return F.col("event_id") % n


def _u(n: int) -> Column:
    return F.col("user_id") % n


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


register("visitor_ids", f"""SELECT event_id, {_CRC32.format(s="'10.0.' || (user_id % 200) || '.' || (event_id % 9) || 'agent ' || (user_id % 6) || 'site' || (user_id % 3) || '.org' || CASE WHEN user_id % 7 <> 0 THEN 'www' || (user_id % 2) || '.org' ELSE '' END")} AS id FROM events""")(
    lambda s, d: tables.table(s, d, "events").select(
        "event_id", scalar.visitor_id(_text("10.0.", _u(200), ".", _e(9)), _text("agent ", _u(6)), _text("site", _u(3), ".org"), F.when(_u(7) != 0, _text("www", _u(2), ".org"))).alias("id")
    )
)
register("page_paths", "SELECT event_id, '/' || CASE WHEN event_id % 4 = 0 THEN '' ELSE 'p/' || (event_id % 12) END || CASE WHEN event_id % 3 = 0 AND user_id % 2 = 1 THEN '#f' || (user_id % 5) ELSE '' END AS page FROM events")(
    lambda s, d: tables.table(s, d, "events").select(
        "event_id", scalar.page_path(_text("https://a.org", F.when(_e(4) == 0, F.lit("")).otherwise(_text("/p/", _e(12))), F.when(_e(3) == 0, _text("#f", _u(5))).otherwise(F.lit(""))), (_u(2)).cast("int")).alias("page")
    )
)
register("clean_domains", "SELECT event_id, CASE event_id % 5 WHEN 4 THEN NULL WHEN 3 THEN 'site' || (user_id % 3) || '.org:8080' ELSE 'site' || (user_id % 3) || '.org' END AS domain FROM events")(
    lambda s, d: tables.table(s, d, "events").select(
        "event_id",
        scalar.clean_domain(
            F.when(_e(5) == 0, _text(" https://www.Site", _u(3), ".org/ ")).when(_e(5) == 1, _text("http://site", _u(3), ".ORG//")).when(_e(5) == 2, _text("www.site", _u(3), ".org")).when(_e(5) == 3, _text("SITE", _u(3), ".org:8080")).otherwise(_text("not a name ", _u(3)))
        ).alias("domain"),
    )
)
register("client_addresses", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN '10.1.0.' || (user_id % 250) WHEN 1 THEN '10.2.0.' || (user_id % 250) WHEN 2 THEN '2001:db8::' || (user_id % 9) WHEN 3 THEN '-' ELSE '10.9.9.' || (user_id % 250) END AS address FROM events")(
    lambda s, d: tables.table(s, d, "events").select(
        "event_id",
        scalar.client_address(
            F.when(_e(5) == 0, F.create_map(F.lit("x-forwarded-for"), _text("10.3.0.", _u(250)), F.lit("x-real-ip"), _text("10.1.0.", _u(250))))
            .when(_e(5) == 1, F.create_map(F.lit("fly-client-ip"), _text("10.2.0.", _u(250)), F.lit("x-real-ip"), F.lit("")))
            .when(_e(5) == 2, F.create_map(F.lit("cf-connecting-ip"), _text("2001:db8::", _u(9))))
            .when(_e(5) == 3, F.create_map(F.lit("x-real-ip"), F.lit("unknown"))),
            _text("10.9.9.", _u(250), ":443"),
        ).alias("address"),
    )
)


@register(
    "site_goals",
    """SELECT domain, name, path FROM (SELECT 'site' || n_nationkey || '.org' AS domain, n_nationkey AS k FROM nation), (VALUES ('signup', NULL, 1), ('buy', NULL, 2), (NULL, '/p/3', 3)) AS g(name, path, n)
WHERE k <> 4 AND (n = 1 OR (n = 3 AND k = 2))""",
)
def site_goals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites of all nations with a goal each; one gets two more, of which one goes again, and one site is deleted."""
    goal = F.struct(F.lit("signup").alias("name"), F.lit(None).cast("string").alias("path"))
    made = tables.table(spark, sf_dir, "nation").select(_text("site", F.col("n_nationkey"), ".org").alias("domain"), F.lit(False).alias("public"), F.array(goal).alias("goals"))
    for name, path in (("buy", None), (None, "/p/3"), ("signup", None)):
        made = sites.add_goal(made, "site2.org", name, path)
    return sites.goals(sites.delete(sites.delete_goal(made, "site2.org", 1), "site4.org"))
