"""Registered queries over the given tables, each with the SQL it equals."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import agent, buckets, periods, scalar
from ..operators import filters, lookups, metrics, shapes, visits
from ..sources import payload, tables
from . import reports

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

NOW_DENSE, NOW_RAW = datetime(2024, 1, 1, 12), datetime(2024, 1, 15)


def _pick(key: str, *names: str | None) -> str:
    cases = " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(names) if n is not None)
    return f"CASE {key} {cases} END"


_HITS = f"""hits AS (
  SELECT 'site' || (user_id % 3) || '.example.com' AS domain, user_id AS id, event_id AS seq, {{ts}} AS ts,
    event_type = 'view' AS view, CASE WHEN event_type <> 'view' THEN event_type END AS event,
    '/p/' || (CAST(json_extract_string(props, '$.k') AS INTEGER) % 12) AS page, 'www' || (user_id % 2) || '.example.com' AS host,
    {_pick("user_id % 5", "Chrome", "Firefox", "Safari", "Edge")} AS browser,
    {_pick("user_id % 5", "Chrome", "Firefox", "Safari", "Edge")} || ' ' || (user_id % 7) AS browser_version,
    {_pick("user_id % 4", "Windows", "macOS", "Linux")} AS os,
    {_pick("user_id % 4", "Windows", "macOS", "Linux")} || ' ' || (user_id % 3) AS os_version,
    {_pick("(user_id // 3) % 3", "Desktop", "Mobile", "Tablet")} AS device,
    n_name AS country, r_name AS subdivision1_code, CAST(nullif((user_id * 7) % 40, 0) AS INTEGER) AS city,
    coalesce({_pick("event_id % 6", "Twitter", "Facebook", "newsletter")}, {_pick("event_id % 5", "Google", "news.example.org", "Twitter")}) AS source,
    {_pick("event_id % 5", "https://google.com", "https://news.example.org/a", "http://t.co")} AS referrer,
    {_pick("event_id % 7", "spring", "launch")} AS utm_campaign, {_pick("event_id % 8", "a", "b")} AS utm_content,
    {_pick("event_id % 4", "social", "email")} AS utm_medium, {_pick("event_id % 6", "Twitter", "Facebook", "newsletter")} AS utm_source,
    {_pick("event_id % 9", "x", "y")} AS utm_term
  FROM events LEFT JOIN nation ON n_nationkey = user_id % 25 LEFT JOIN region ON r_regionkey = n_regionkey
)"""
_CLOCK = {"raw": "ts", "dense": f"make_timestamp({tables.ORIGIN} + ((epoch_us(ts) - {tables.ORIGIN}) // {tables.DENSE}))"}
_VISITS = """, numbered AS (
  SELECT *, row_number() OVER (PARTITION BY domain, id ORDER BY ts, seq) AS rn FROM hits
), chain AS (
  SELECT domain, id, rn, epoch_us(ts) AS vs FROM numbered WHERE rn = 1
  UNION ALL
  SELECT n.domain, n.id, n.rn, CASE WHEN epoch_us(n.ts) - c.vs >= 900000000 THEN epoch_us(n.ts) ELSE c.vs END
  FROM chain c JOIN numbered n ON n.domain = c.domain AND n.id = c.id AND n.rn = c.rn + 1
), placed AS (
  SELECT n.* EXCLUDE (host), c.vs AS visit_start, n.host AS full_host, CASE WHEN n.view THEN n.page END AS seen,
    row_number() OVER (PARTITION BY n.domain, n.id, c.vs ORDER BY n.ts, n.seq) AS k,
    epoch_us(n.ts) - lag(epoch_us(n.ts)) OVER (PARTITION BY n.domain, n.id, c.vs ORDER BY n.ts, n.seq) AS gap,
    first_value(CASE WHEN n.view THEN n.page END) OVER (PARTITION BY n.domain, n.id, c.vs ORDER BY n.ts, n.seq) AS first_seen,
    last_value(CASE WHEN n.view THEN n.page END IGNORE NULLS) OVER (PARTITION BY n.domain, n.id, c.vs ORDER BY n.ts, n.seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS true_exit_page,
    c.vs > min(epoch_us(n.ts)) OVER (PARTITION BY n.domain, n.id) AS again
  FROM numbered n JOIN chain c ON n.domain = c.domain AND n.id = c.id AND n.rn = c.rn
), visits AS (
  SELECT *, k = 1 AS session, CASE k WHEN 1 THEN 1 WHEN 2 THEN -1 ELSE 0 END AS bounce, coalesce(gap, 0) AS duration,
    coalesce(first_seen, seen) AS entry_page, coalesce(seen, first_seen) AS exit_page, CASE WHEN view THEN full_host END AS host
  FROM placed
)"""


def _with(clock: str, visited: bool = True) -> str:
    """The SQL head that makes ``visits`` (or ``hits`` alone)."""
    return ("WITH RECURSIVE " if visited else "WITH ") + _HITS.format(ts=_CLOCK[clock]) + (_VISITS if visited else "")


_SUMS = {
    "visitors": "CAST(count(DISTINCT id) AS DOUBLE)",
    "visits": "CAST(count(*) FILTER (WHERE session) AS DOUBLE)",
    "pageviews": "CAST(count(*) FILTER (WHERE view) AS DOUBLE)",
    "events": "CAST(count(*) AS DOUBLE)",
    "_bounce": "CAST(coalesce(sum(bounce), 0) AS DOUBLE)",
    "_duration": "CAST(coalesce(sum(duration), 0) AS DOUBLE)",
}
_RATIOS = {
    "views_per_visit": "CASE WHEN visits <> 0 THEN round(pageviews / visits) ELSE pageviews END",
    "bounce_rate": "greatest(CASE WHEN visits <> 0 THEN floor(_bounce / visits * 100) ELSE _bounce END, 0.0)",
    "visit_duration": "floor(CASE WHEN visits <> 0 THEN _duration / 1e6 / visits ELSE _duration / 1e6 END)",
}


def _metric(name: str) -> str:
    return f"CAST({_RATIOS[name]} AS DOUBLE) AS {name}" if name in _RATIOS else name


def _measured(rows: str, keys: dict[str, str], names, where: str = "TRUE") -> str:
    """SELECT of metrics by ``keys`` (name to expression) over ``rows``."""
    inner = ", ".join([*(f"{e} AS {k}" for k, e in keys.items()), *(f"{e} AS {n}" for n, e in _SUMS.items())])
    group = f"GROUP BY {', '.join(keys.values())}" if keys else ""
    outer = ", ".join([*keys, *map(_metric, names)])
    return f"SELECT {outer} FROM (SELECT {inner} FROM {rows} WHERE {where} {group})"


def register(name: str, sql: str | None = None):
    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return put


def hits(spark: SparkSession, sf_dir: str, clock: str = "dense") -> DataFrame:
    return tables.hits(spark, sf_dir, clock)


def visited(spark: SparkSession, sf_dir: str, clock: str = "dense", names: tuple[str, ...] | list[str] = metrics.NAMES) -> DataFrame:
    """Hits with their part in their visit, or plain hits where the metrics ``names`` need no visits."""
    rows = hits(spark, sf_dir, clock)
    return rows if set(names) <= set(metrics.PLAIN) else visits.visits(rows)


SITE = "site1.example.com"
_PLAIN = "domain, id, seq, ts, view, event, page, host, browser, browser_version, os, os_version, device, country, subdivision1_code, city, source, referrer, utm_campaign, utm_content, utm_medium, utm_source, utm_term"

# Hits and visits

for _clock in ("raw", "dense"):
    register(f"hits_{_clock}", f"{_with(_clock, False)} SELECT {_PLAIN} FROM hits")(lambda s, d, c=_clock: hits(s, d, c).select(*_PLAIN.split(", ")))
    _rows = "domain, id, seq, visit_start, session, bounce, duration, entry_page, exit_page, true_exit_page, host"
    register(f"visits_{_clock}", f"{_with(_clock)} SELECT {_rows} FROM visits")(lambda s, d, c=_clock, r=_rows: visited(s, d, c).select(*r.split(", ")))

_again = """CASE WHEN again AND k = 1 THEN NULL WHEN again THEN seen ELSE coalesce(first_seen, seen) END AS entry_page,
  CASE WHEN again AND k = 1 THEN NULL WHEN again THEN seen ELSE coalesce(seen, first_seen) END AS exit_page,
  CASE WHEN again AND k = 1 THEN full_host WHEN view THEN full_host END AS host"""


@register("visits_compat", f"{_with('dense')} SELECT domain, id, seq, {_again} FROM placed")
def visits_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visits.visits(hits(spark, sf_dir), compat=True).select("domain", "id", "seq", "entry_page", "exit_page", "host")


@register(
    "visit_invariants",
    f"{_with('dense')} SELECT domain, count(*) AS visits, sum(n) AS hits, count(*) FILTER (WHERE bounces = CASE WHEN n = 1 THEN 1 ELSE 0 END AND span = spent) AS kept_rules "
    "FROM (SELECT domain, id, visit_start, count(*) AS n, sum(bounce) AS bounces, sum(duration) AS spent, max(epoch_us(ts)) - min(epoch_us(ts)) AS span FROM visits GROUP BY ALL) GROUP BY domain",
)
def visit_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per site how many visits add up: bounces 1 exactly for single hits, durations the span."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    each = visited(spark, sf_dir).groupBy("domain", "id", "visit_start").agg(F.count("*").alias("n"), F.sum("bounce").alias("b"), F.sum("duration").alias("spent"), (F.max(us) - F.min(us)).alias("span"))
    fine = (F.col("b") == F.when(F.col("n") == 1, 1).otherwise(0)) & (F.col("span") == F.col("spent"))
    return each.groupBy("domain").agg(F.count("*").alias("visits"), F.sum("n").alias("hits"), F.count_if(fine).alias("kept_rules"))


# Metrics, alone and together

for _m in metrics.NAMES:
    register(f"agg_{_m}", f"{_with('dense')} {_measured('visits', {'domain': 'domain'}, [_m])}")(lambda s, d, m=_m: metrics.measure(visited(s, d, names=[m]), ["domain"], [m]))
register("agg_all", f"{_with('dense')} {_measured('visits', {}, metrics.NAMES)}")(lambda s, d: shapes.aggregate(visited(s, d), metrics.NAMES))
register("agg_per_site", f"{_with('dense')} {_measured('visits', {'domain': 'domain'}, metrics.NAMES)}")(lambda s, d: metrics.measure(visited(s, d), ["domain"], metrics.NAMES))

# Time series

_BUCKET = {
    "minute": "date_trunc('minute', ts)", "hour": "date_trunc('hour', ts)", "date": "date_trunc('day', ts)",
    "week": "date_trunc('week', ts + INTERVAL 1 DAY) - INTERVAL 1 DAY", "month": "date_trunc('month', ts)",
}
for _i in buckets.INTERVALS:
    _clock = "dense" if _i in ("minute", "hour") else "raw"
    _label = f"strftime({_BUCKET[_i]}, '{'%Y-%m-%d' if _i in ('week', 'month') else '%Y-%m-%d %H:%M:%S'}')"
    register(f"ts_{_i}", f"{_with(_clock)} {_measured('visits', {'timestamp': _label}, metrics.NAMES)}")(lambda s, d, i=_i, c=_clock: shapes.timeseries(visited(s, d, c), i, metrics.NAMES))
    register(f"main_graph_{_i}", f"{_with(_clock)}, points AS ({_measured('visits', {'timestamp': _label}, ['visitors'], f"domain = '{SITE}'")}) SELECT string_agg(timestamp, '|' ORDER BY timestamp) AS labels, string_agg(CAST(CAST(visitors AS BIGINT) AS VARCHAR), '|' ORDER BY timestamp) AS plot FROM points")(
        lambda s, d, i=_i, c=_clock: reports.main_graph(hits(s, d, c).filter(F.col("domain") == SITE), i).select(
            F.array_join("labels", "|").alias("labels"), F.array_join(F.transform("plot", lambda x: x.cast("bigint").cast("string")), "|").alias("plot")
        )
    )

# Periods


def _bounds(p: periods.Period) -> str:
    first, after = periods.truncated(p.start, p.interval), periods.following(periods.truncated(p.end, p.interval), p.interval)
    return f"ts >= TIMESTAMP '{first}' AND ts < TIMESTAMP '{after}'"


_PERIODS = {
    "day": ("day", "2024-01-10"), "7d": ("7d", "2024-01-15"), "30d": ("30d", "2024-01-31"), "month": ("month", "2024-01-20"), "6mo": ("6mo", "2024-02-01"),
    "12mo": ("12mo", "2024-06-01"), "year": ("year", "2024-03-01"), "all": ("all", None), "custom": ("custom", "2024-01-05,2024-01-09"),
}
for _name, (_p, _d) in _PERIODS.items():
    _period = periods.period(_p, NOW_RAW, _d)
    register(f"period_{_name}", f"{_with('raw')} {_measured('visits', {'domain': 'domain'}, metrics.NAMES, _bounds(_period))}")(lambda s, d, p=_period: metrics.measure(shapes.select(visited(s, d, "raw"), period=p), ["domain"], metrics.NAMES))
_recent = periods.period("realtime", NOW_DENSE)
register("period_realtime", f"{_with('dense')} {_measured('visits', {'domain': 'domain'}, metrics.NAMES, _bounds(_recent))}")(lambda s, d: metrics.measure(shapes.select(visited(s, d), period=_recent), ["domain"], metrics.NAMES))

# Filters

_FILTERS = {
    "is": ([("is", "event:page", ["/p/1", "/p/2"])], "page IN ('/p/1', '/p/2')"),
    "is_not": ([("is_not", "visit:utm_source", ["Twitter", "Facebook"])], "utm_source IS NOT NULL AND utm_source NOT IN ('Twitter', 'Facebook')"),
    "matches": ([("matches", "event:page", ["^/p/1.*", "/p/3$"])], "regexp_matches(page, '^/p/1.*') OR regexp_matches(page, '/p/3$')"),
    "matches_plain": ([("matches", "event:page", ["/p/4"])], "page = '/p/4'"),
    "does_not_match": ([("does_not_match", "visit:referrer", ["^https://.*"])], "referrer IS NOT NULL AND NOT regexp_matches(referrer, '^https://.*')"),
    "contains": ([("contains", "visit:referrer", ["google", "t.co"])], "regexp_matches(referrer, 'google|t.co')"),
    "does_not_contain": ([("does_not_contain", "visit:source", ["oo", "news"])], "source IS NOT NULL AND NOT regexp_matches(source, 'oo|news')"),
    "city": ([("is", "visit:city", ["7", "14", "21"])], "city IN (7, 14, 21)"),
    "city_not": ([("is_not", "visit:city", ["7"])], "city IS NOT NULL AND city <> 7"),
    "and_multi": ([("is", "visit:browser", ["Chrome"]), ("is_not", "visit:os", ["Linux"]), ("contains", "event:page", ["/p/"])], "browser = 'Chrome' AND os IS NOT NULL AND os <> 'Linux' AND page LIKE '%/p/%'"),
    "goal_event": (filters.parse('[["is", "event:goal", ["signup"]]]'), "event = 'signup'"),
    "goal_page": (filters.parse('[["is", "event:goal", ["Visit /p/3"]]]'), "page = '/p/3'"),
    "json": (filters.parse('[["is", "visit:screen", ["Mobile"]], ["is", "visit:city", [7, 14, 35]], ["bad"], ["is", "visit:region", ["ASIA", "EUROPE", "AFRICA"]]]'), "device = 'Mobile' AND city IN (7, 14, 35) AND subdivision1_code IN ('ASIA', 'EUROPE', 'AFRICA')"),
    "entry_page": ([("is", "visit:entry_page", ["/p/5"])], "entry_page = '/p/5'"),
}
for _name, (_items, _where) in _FILTERS.items():
    register(f"filter_{_name}", f"{_with('dense')} {_measured('visits', {'domain': 'domain'}, metrics.NAMES, f'({_where})')}")(lambda s, d, w=_items: metrics.measure(shapes.select(visited(s, d), where=w), ["domain"], metrics.NAMES))
register("filter_exists", f"{_with('dense', False)} SELECT domain, count(*) AS n FROM hits WHERE utm_campaign IS NOT NULL GROUP BY domain")(lambda s, d: hits(s, d).filter(F.col("utm_campaign").isNotNull()).groupBy("domain").agg(F.count("*").alias("n")))
register("filter_sets", f"{_with('dense', False)} SELECT domain, count(*) FILTER (WHERE a AND b) AS both, count(*) FILTER (WHERE a OR b) AS either, count(*) FILTER (WHERE a AND NOT b) AS first_only FROM (SELECT domain, coalesce(browser = 'Chrome', FALSE) AS a, coalesce(utm_medium = 'email', FALSE) AS b FROM hits) GROUP BY domain")(
    lambda s, d: hits(s, d)
    .select("domain", F.coalesce(F.col("browser") == "Chrome", F.lit(False)).alias("a"), F.coalesce(F.col("utm_medium") == "email", F.lit(False)).alias("b"))
    .groupBy("domain")
    .agg(F.count_if(F.col("a") & F.col("b")).alias("both"), F.count_if(F.col("a") | F.col("b")).alias("either"), F.count_if(F.col("a") & ~F.col("b")).alias("first_only"))
)

# Breakdowns

for _prop in ("event", "page", "host", "entry_page", "exit_page", "source", "referrer", "utm_source", "utm_medium", "utm_campaign", "utm_content", "utm_term", "browser", "browser_version", "os", "os_version", "device", "country", "subdivision1_code", "city"):
    register(f"bd_{_prop}", f"{_with('dense')} {_measured('visits', {_prop: _prop}, metrics.NAMES, f'{_prop} IS NOT NULL')}")(lambda s, d, p=_prop: shapes.breakdown(visited(s, d), p, metrics.NAMES))
for _prop in ("browser", "browser_version", "os", "os_version", "device"):
    register(f"bd_pct_{_prop}", f"{_with('dense')}, g AS ({_measured('visits', {_prop: _prop}, ['visitors'], f'{_prop} IS NOT NULL')}) SELECT {_prop}, visitors, CAST(floor(visitors / sum(visitors) OVER () * 100) AS DOUBLE) AS percentage FROM g")(
        lambda s, d, p=_prop: shapes.breakdown_share(hits(s, d) if p not in ("host", "entry_page", "exit_page") else visited(s, d), p)
    )
register("bd_page_limit", f"{_with('dense')}, g AS ({_measured('visits', {'page': 'page'}, ['visitors', 'pageviews'], 'page IS NOT NULL')}) SELECT page, visitors, pageviews FROM g ORDER BY visitors DESC, page LIMIT 5 OFFSET 2")(lambda s, d: shapes.breakdown(visited(s, d), "page", ["visitors", "pageviews"], 5, 2))
register("exit_pages", f"{_with('dense')}, g AS ({_measured('visits', {'exit_page': 'exit_page'}, ['visitors', 'visits', 'pageviews'], 'exit_page IS NOT NULL')}) SELECT exit_page, visitors, visits, CAST(floor(visits / sum(pageviews) OVER () * 100) AS DOUBLE) AS exit_rate FROM g")(lambda s, d: shapes.exit_pages(visited(s, d)))

# Reports

_GOALS = "goals(domain, name, path) AS (SELECT 'site' || k || '.example.com', name, path FROM (VALUES (0), (1), (2)) AS s(k), (VALUES ('signup', NULL), ('purchase', NULL), (NULL, '/p/3')) AS g(name, path))"
_GOALED = f"{_with('dense')}, {_GOALS}, won AS (SELECT v.domain, coalesce(g.name, 'Visit ' || g.path) AS goal, CAST(count(DISTINCT v.id) AS DOUBLE) AS visitors, CAST(count(*) AS DOUBLE) AS events FROM visits v JOIN goals g ON v.domain = g.domain AND (v.event = g.name OR v.page = g.path) GROUP BY ALL)"
register("goals", f"{_GOALED} SELECT domain, goal, visitors, events FROM won")(lambda s, d: shapes.goals(hits(s, d), tables.goals(s)))
register("conversions", f"{_GOALED} SELECT w.domain, goal, visitors, events, CAST(round(visitors / n * 100) AS DOUBLE) AS conversion_rate FROM won w JOIN (SELECT domain, CAST(count(DISTINCT id) AS DOUBLE) AS n FROM visits GROUP BY domain) a ON a.domain = w.domain")(
    lambda s, d: shapes.conversions(hits(s, d), tables.goals(s))
)
_DETAILS = reports.DETAILS
register("report_sources", f"{_with('dense')} {_measured('visits', {'source': 'source'}, _DETAILS, 'source IS NOT NULL')}")(lambda s, d: reports.sources(visited(s, d), True))
for _utm in ("utm_source", "utm_medium", "utm_campaign", "utm_content", "utm_term"):
    register(f"report_{_utm}", f"{_with('dense')} {_measured('visits', {_utm: _utm}, _DETAILS, f'{_utm} IS NOT NULL')}")(lambda s, d, u=_utm: reports.campaign(visited(s, d), u, True))
register("report_referrers", f"{_with('dense')} {_measured('visits', {'referrer': "regexp_replace(referrer, '^https?://', '')"}, _DETAILS, "source = 'Twitter' AND referrer IS NOT NULL")}")(lambda s, d: reports.referrers(visited(s, d), "Twitter", True))
register("report_pages", f"{_with('dense')} {_measured('visits', {'page': 'page'}, ['visitors', 'pageviews', 'bounce_rate'], 'page IS NOT NULL')}")(lambda s, d: reports.pages(visited(s, d), True))
register("report_entry_pages", f"{_with('dense')} {_measured('visits', {'entry_page': 'entry_page'}, ['visitors', 'visits', 'visit_duration'], 'entry_page IS NOT NULL')}")(lambda s, d: reports.entry_pages(visited(s, d)))
register("report_countries", f"{_with('dense')}, g AS ({_measured('visits', {'country': 'country'}, ['visitors'], 'country IS NOT NULL')}) SELECT country, visitors, substr(n_name, 1, 3) AS alpha3, n_name AS name FROM g LEFT JOIN nation ON n_name = country")(
    lambda s, d: reports.countries(hits(s, d), tables.table(s, d, "nation").select(F.col("n_name").alias("country"), F.substring("n_name", 1, 3).alias("alpha3"), F.col("n_name").alias("name")))
)
register("report_cities", f"{_with('dense')}, g AS ({_measured('visits', {'city': 'city'}, ['visitors'], 'city IS NOT NULL')}) SELECT city, visitors, coalesce(n_name, 'N/A') AS name FROM g LEFT JOIN nation ON n_nationkey = city")(
    lambda s, d: reports.cities(hits(s, d), tables.table(s, d, "nation").select(F.col("n_nationkey").alias("city"), F.col("n_name").alias("name")))
)
register("report_seen_first", f"{_with('dense', False)} SELECT s.domain, h.domain IS NOT NULL AS seen FROM (SELECT 'site' || n_nationkey || '.example.com' AS domain FROM nation) s LEFT JOIN (SELECT DISTINCT domain FROM hits) h ON h.domain = s.domain")(
    lambda s, d: reports.seen_first(hits(s, d), tables.table(s, d, "nation").select(F.concat(F.lit("site"), F.col("n_nationkey").cast("string"), F.lit(".example.com")).alias("domain")))
)
for _prop in ("page", "country", "source"):
    register(f"suggest_{_prop}", f"{_with('dense', False)} SELECT DISTINCT {_prop} AS value, {_prop} AS label FROM hits WHERE {_prop} IS NOT NULL AND domain = '{SITE}'")(lambda s, d, p=_prop: shapes.distinct_values(hits(s, d).filter(F.col("domain") == SITE), p))
register("suggest_prefix", f"{_with('dense', False)} SELECT DISTINCT page AS value, page AS label FROM hits WHERE page LIKE '/p/1%' AND domain = '{SITE}'")(lambda s, d: shapes.distinct_values(hits(s, d).filter(F.col("domain") == SITE), "page", "/p/1"))
_FLAG = "chr(127397 + ascii(substr({c}, 1, 1))) || chr(127397 + ascii(substr({c}, 2, 1)))"
register("report_regions", f"{_with('dense')}, g AS ({_measured('visits', {'subdivision1_code': 'subdivision1_code'}, ['visitors'], 'subdivision1_code IS NOT NULL')}) SELECT subdivision1_code, visitors, 'Region ' || r_regionkey AS name, substr(r_name, 1, 2) AS country, {_FLAG.format(c='substr(r_name, 1, 2)')} AS flag FROM g LEFT JOIN region ON r_name = subdivision1_code")(
    lambda s, d: reports.regions(hits(s, d), tables.table(s, d, "region").select(F.col("r_name").alias("code"), F.concat(F.lit("Region "), F.col("r_regionkey").cast("string")).alias("name"), F.substring("r_name", 1, 2).alias("country")))
)
register("report_country_flags", f"{_with('dense')}, g AS ({_measured('visits', {'country': 'country'}, ['visitors'], 'country IS NOT NULL')}) SELECT country, visitors, substr(n_name, 1, 3) AS alpha3, n_name AS name, {_FLAG.format(c='substr(n_name, 1, 2)')} AS flag FROM g LEFT JOIN nation ON n_name = country")(
    lambda s, d: reports.countries(hits(s, d), tables.table(s, d, "nation").select(F.col("n_name").alias("country"), F.substring("n_name", 1, 3).alias("alpha3"), F.substring("n_name", 1, 2).alias("alpha2"), F.col("n_name").alias("name")))
)
register("region_names", "SELECT n_nationkey, 'Region ' || r_regionkey AS region FROM nation JOIN region ON n_regionkey = r_regionkey")(
    lambda s, d: lookups.with_region(
        tables.table(s, d, "nation").join(tables.table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("subdivision1_code")),
        tables.table(s, d, "region").select(F.col("r_name").alias("code"), F.concat(F.lit("Region "), F.col("r_regionkey").cast("string")).alias("name")),
    ).select("n_nationkey", "region")
)
register("suggest_region_names", f"{_with('dense', False)} SELECT DISTINCT subdivision1_code AS value, 'Region ' || r_regionkey AS label FROM hits LEFT JOIN region ON r_name = subdivision1_code WHERE subdivision1_code IS NOT NULL AND domain = '{SITE}'")(
    lambda s, d: shapes.distinct_values(hits(s, d).filter(F.col("domain") == SITE), "subdivision1_code", names=tables.table(s, d, "region").select(F.col("r_name").alias("value"), F.concat(F.lit("Region "), F.col("r_regionkey").cast("string")).alias("label")))
)
_five = periods.Period(datetime(2024, 1, 1, 11, 55), NOW_DENSE, "minute")
register("realtime", f"{_with('dense')} {_measured('visits', {'domain': 'domain'}, ['visitors'], _bounds(_five))}")(lambda s, d: shapes.realtime(hits(s, d), NOW_DENSE))
_day = periods.Period(datetime(2024, 1, 14), NOW_RAW, "hour")
register("visitors_24h", f"{_with('raw')} {_measured('visits', {'domain': 'domain'}, ['visitors'], _bounds(_day))}")(lambda s, d: shapes.visitors_24h(hits(s, d, "raw"), NOW_RAW))


def _changes(period: periods.Period, how: str) -> str:
    before = periods.compared(period, how, NOW_RAW)
    now, then = (f"({_measured('visits', {'domain': 'domain'}, metrics.TOP, _bounds(p))})" for p in (period, before))
    out = []
    for m in metrics.TOP:
        a, b = f"coalesce(a.{m}, 0.0)", f"coalesce(b.{m}, 0.0)"
        diff = f"{a} - {b}" if m == "bounce_rate" else f"CASE WHEN {b} = 0 AND {a} > 0 THEN 100.0 WHEN {b} = 0 AND {a} = 0 THEN 0.0 ELSE round(({a} - {b}) / nullif({b}, 0.0) * 100) END"
        out += [f"CAST({a} AS DOUBLE) AS {m}", f"CAST({diff} AS DOUBLE) AS {m}_change"]
    return f"{_with('raw')} SELECT coalesce(a.domain, b.domain) AS domain, {', '.join(out)} FROM {now} a FULL JOIN {then} b ON a.domain = b.domain"


_week, _january = periods.period("7d", NOW_RAW, "2024-01-15"), periods.period("month", NOW_RAW, "2024-01-15")
for _name, _period, _how in (("prev", _week, "previous_period"), ("yoy", _january, "year_over_year")):
    register(f"top_stats_{_name}", _changes(_period, _how))(lambda s, d, p=_period, h=_how: shapes.top_stats(visited(s, d, "raw"), None, p, h, NOW_RAW, by=["domain"]))

# Scalar functions over page addresses and events

register(
    "url_parts",
    r"SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, nullif(regexp_extract(url, '^https?://[^/?#]+(/[^?#]*)', 1), '') AS page, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS q_page, nullif(regexp_extract(url, '[?&]ref=([^&#]*)', 1), '') AS q_ref, nullif(regexp_extract(url, '#(.*)$', 1), '') AS fragment FROM pages",
)(
    lambda s, d: tables.table(s, d, "pages").select(
        "page_id", scalar.url_part(F.col("url"), "HOST").alias("host"), scalar.filled(scalar.url_part(F.col("url"), "PATH")).alias("page"),
        scalar.url_query(F.col("url"), "page").alias("q_page"), scalar.url_query(F.col("url"), "ref").alias("q_ref"), scalar.filled(scalar.url_part(F.col("url"), "REF")).alias("fragment"),
    )
)
register("host_clean", r"SELECT page_id, regexp_replace(regexp_extract(url, '^https?://([^/?#]+)', 1), '^www\.', '') AS host FROM pages")(lambda s, d: tables.table(s, d, "pages").select("page_id", scalar.clean_host(scalar.url_part(F.col("url"), "HOST")).alias("host")))
register("referrer_clean", r"SELECT page_id, regexp_replace(regexp_replace(CASE WHEN page_id % 3 = 0 THEN 'https://' || regexp_replace(url, '^https?://', '') ELSE url END, '^(https?://)www\.', '\1'), '/$', '') AS referrer FROM pages")(
    lambda s, d: tables.table(s, d, "pages").select("page_id", scalar.clean_referrer(F.when(F.col("page_id") % 3 == 0, scalar.shown_referrer(F.col("url"))).otherwise(F.col("url"))).alias("referrer"))
)
_KNOWN = ", ".join(f"('{h}', '{n}')" for h, n in lookups.SOURCES.items())
register("source_resolve", f"{_with('dense', False)}, known(host, name) AS (VALUES {_KNOWN}) SELECT seq, coalesce(utm_source, name, regexp_extract(referrer, '^https?://([^/]+)', 1)) AS source FROM hits LEFT JOIN known ON known.host = regexp_extract(referrer, '^https?://([^/]+)', 1)")(
    lambda s, d: lookups.with_source(hits(s, d).drop("source"), "referrer", {"a": F.col("utm_source")}).select("seq", "source")
)

# Whole-number predicates and sums

_COMPARE = {"eq": (5, None, "= 5"), "neq": (5, None, "<> 5"), "lt": (10, None, "< 10"), "lte": (10, None, "<= 10"), "gt": (40, None, "> 40"), "gte": (40, None, ">= 40"), "between": (10, 20, "BETWEEN 10 AND 20")}
for _op, (_low, _high, _sql) in _COMPARE.items():
    register(f"bsi_{_op}", f"SELECT l_returnflag, count(*) AS n, sum(CAST(l_quantity AS BIGINT)) AS total FROM lineitem WHERE CAST(l_quantity AS BIGINT) {_sql} GROUP BY l_returnflag")(
        lambda s, d, o=_op, a=_low, b=_high: tables.table(s, d, "lineitem").filter(filters.compare(F.col("l_quantity").cast("bigint"), o, a, b)).groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("bigint")).alias("total"))
    )
register("bsi_sum", "SELECT count(*) AS n, sum(CAST(l_quantity AS BIGINT)) AS total FROM lineitem")(lambda s, d: tables.table(s, d, "lineitem").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("bigint")).alias("total")))
register("bsi_distinct", "SELECT o_orderpriority, count(DISTINCT o_custkey) AS n FROM orders GROUP BY o_orderpriority")(lambda s, d: tables.table(s, d, "orders").groupBy("o_orderpriority").agg(F.count_distinct("o_custkey").alias("n")))
register("bitmap_distinct", "SELECT o_orderpriority, count(DISTINCT o_custkey) AS n FROM orders GROUP BY o_orderpriority")(
    lambda s, d: tables.table(s, d, "orders").groupBy("o_orderpriority", F.bitmap_bucket_number("o_custkey").alias("b")).agg(F.bitmap_count(F.bitmap_construct_agg(F.bitmap_bit_position("o_custkey"))).alias("n")).groupBy("o_orderpriority").agg(F.sum("n").alias("n"))
)

# Ingest: payloads made from events, taken through JSON, validation and enrichment

AGENTS = (
    ("Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0.0.0 Safari/537.36", "Chrome", "120.0.0.0", "Windows", "10.0", "Desktop"),
    ("Mozilla/5.0 (iPhone; CPU iPhone OS 17_1 like Mac OS X) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/17.1 Mobile/15E148 Safari/604.1", "Safari", "17.1", "iOS", "17.1", "Mobile"),
    ("Mozilla/5.0 (Macintosh; Intel Mac OS X 10.15; rv:121.0) Gecko/20100101 Firefox/121.0", "Firefox", "121.0", "macOS", "10.15", "Desktop"),
    ("Mozilla/5.0 (Linux; Android 13; SM-T500) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/119.0.0.0 Safari/537.36", "Chrome", "119.0.0.0", "Android", "13", "Tablet"),
    ("Mozilla/5.0 (compatible; Googlebot/2.1; +http://www.google.com/bot.html)", None, None, None, None, None),
    ("Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0.0.0 Safari/537.36 Edg/120.0.2210.61", "Microsoft Edge", "120.0.2210.61", "Windows", "10.0", "Desktop"),
)


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON payload for each event, in short or long names; some lack a name, a host or a known site."""
    e, u = F.col("event_id"), F.col("user_id")
    ua = F.element_at(F.array(*[F.lit(a[0]) for a in AGENTS]), (u % len(AGENTS) + 1).cast("int"))
    url = F.when(e % 13 == 0, F.lit("/no/host")).otherwise(F.concat(F.lit("https://www.site"), (u % 3).cast("string"), F.lit(".example.com/p/"), (e % 12).cast("string"), F.when(e % 4 == 0, F.lit("?utm_source=Mail&utm_medium=email")).when(e % 4 == 1, F.lit("?ref=friend")).otherwise(F.lit(""))))
    name = F.when(e % 11 == 0, F.lit("")).when(F.col("event_type") == "view", "pageview").otherwise(F.col("event_type"))
    domain = F.concat(F.lit("site"), (u % 4).cast("string"), F.lit(".example.com,other.example.com"))
    referrer = F.when(e % 3 == 0, F.lit("https://www.google.com/")).when(e % 3 == 1, F.lit("news.example.org/a/"))
    short = e % 2 == 0
    fields = {"n": F.when(short, name), "name": F.when(~short, name), "u": F.when(short, url), "url": F.when(~short, url), "d": F.when(short, domain), "domain": F.when(~short, domain), "r": F.when(short, referrer), "referrer": F.when(~short, referrer)}
    address = F.concat_ws(".", F.lit("10"), (u % 25).cast("string"), (e % 5).cast("string"), F.lit("7"))
    made = F.struct(*[c.alias(k) for k, c in fields.items()], F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"), address.alias("remote_ip"), ua.alias("user_agent"))
    return tables.table(spark, sf_dir, "events").select(F.to_json(made).alias("json"))


def _ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An address range for each nation, and a narrower one inside it."""
    n = tables.table(spark, sf_dir, "nation").select((F.lit(10 * 2**24).cast("long") + F.col("n_nationkey") * 65536).alias("low"), F.col("n_name").alias("country"))
    wide = n.select("low", (F.col("low") + 65535).alias("high"), "country", F.lit(None).cast("string").alias("subdivision1_code"), F.lit(None).cast("int").alias("city"))
    narrow = n.select((F.col("low") + 512).alias("low"), (F.col("low") + 767).alias("high"), "country", F.lit("inner").alias("subdivision1_code"), F.lit(9).alias("city"))
    return wide.unionByName(narrow)


def _sites(spark: SparkSession) -> DataFrame:
    return tables.goals(spark).select("domain").distinct()


def _agent_case(column: int) -> str:
    return "CASE user_id % 6 " + " ".join(f"WHEN {k} THEN '{a[column]}'" for k, a in enumerate(AGENTS) if a[column]) + " END"


_NAME = "CASE WHEN event_id % 11 = 0 THEN '' WHEN event_type = 'view' THEN 'pageview' ELSE event_type END"
_VALID = f"""WITH sent AS (SELECT *, {_NAME} AS name, user_id % 4 AS site FROM events),
fine AS (SELECT * FROM sent WHERE name <> '' AND event_id % 13 <> 0 AND site < 3 AND user_id % 6 <> 4)"""


@register("ingest_faults", f"WITH sent AS (SELECT *, {_NAME} AS name FROM events) SELECT fault, count(*) AS n FROM (SELECT CASE WHEN name = '' THEN 'no name' WHEN event_id % 13 = 0 THEN 'no host' END AS fault FROM sent) WHERE fault IS NOT NULL GROUP BY fault")
def ingest_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payload.split(payload.from_text(payloads(spark, sf_dir), "json"))[1].groupBy("fault").agg(F.count("*").alias("n"))


@register(
    "ingest_hits",
    f"""{_VALID} SELECT 'site' || site || '.example.com' AS domain, date_trunc('second', ts) AS ts, name = 'pageview' AS view, CASE WHEN name <> 'pageview' THEN name END AS event,
  '/p/' || (event_id % 12) AS page, 'site' || (user_id % 3) || '.example.com' AS host, {_agent_case(1)} AS browser, {_agent_case(2)} AS browser_version, {_agent_case(3)} AS os, {_agent_case(4)} AS os_version, {_agent_case(5)} AS device,
  n_name AS country, CASE WHEN event_id % 5 = 2 THEN 'inner' END AS subdivision1_code, CASE WHEN event_id % 5 = 2 THEN 9 END AS city,
  CASE WHEN event_id % 4 = 0 THEN 'Mail' WHEN event_id % 4 = 1 THEN 'friend' WHEN event_id % 3 = 0 THEN 'Google' WHEN event_id % 3 = 1 THEN 'news.example.org' END AS source,
  CASE event_id % 3 WHEN 0 THEN 'https://google.com' WHEN 1 THEN 'https://news.example.org/a' END AS referrer,
  CASE WHEN event_id % 4 = 0 THEN 'Mail' END AS utm_source, CASE WHEN event_id % 4 = 0 THEN 'email' END AS utm_medium
  FROM fine LEFT JOIN nation ON n_nationkey = user_id % 25""",
)
def ingest_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid, _ = payload.split(payload.from_text(payloads(spark, sf_dir), "json"))
    made = payload.enriched(valid, _sites(spark), _ranges(spark, sf_dir))
    return made.select("domain", "ts", "view", "event", "page", "host", "browser", "browser_version", "os", "os_version", "device", "country", "subdivision1_code", "city", "source", "referrer", "utm_source", "utm_medium")


register("bot_filter", "SELECT count(*) AS n, count(*) FILTER (WHERE user_id % 6 = 4) AS bots FROM events")(lambda s, d: payload.from_text(payloads(s, d), "json").agg(F.count("*").alias("n"), F.count_if(agent.is_bot(F.col("user_agent"))).alias("bots")))
register("site_admission", "SELECT 'site' || (user_id % 4) || '.example.com' AS domain, count(*) AS n FROM events WHERE user_id % 4 < 3 GROUP BY 1")(
    lambda s, d: lookups.known_sites(payload.parsed(payload.from_text(payloads(s, d), "json")), _sites(s)).groupBy("domain").agg(F.count("*").alias("n"))
)
register("place_lookup", "SELECT event_id, n_name AS country, CASE WHEN event_id % 5 = 2 THEN 'inner' END AS subdivision1_code, CASE WHEN event_id % 5 = 2 THEN 9 END AS city FROM events LEFT JOIN nation ON n_nationkey = user_id % 25")(
    lambda s, d: lookups.with_place(tables.table(s, d, "events").select("event_id", F.concat_ws(".", F.lit("10"), (F.col("user_id") % 25).cast("string"), (F.col("event_id") % 5).cast("string"), F.lit("7")).alias("remote_ip")), _ranges(s, d)).select("event_id", "country", "subdivision1_code", "city")
)
register("goal_matches", f"{_with('dense', False)}, {_GOALS} SELECT h.seq, coalesce(g.name, 'Visit ' || g.path) AS goal FROM hits h JOIN goals g ON h.domain = g.domain AND (h.event = g.name OR h.page = g.path)")(
    lambda s, d: hits(s, d).alias("h").join(tables.goals(s).alias("g"), F.expr("h.domain = g.domain and (h.event = g.name or h.page = g.path)")).select("seq", F.coalesce("g.name", F.concat(F.lit("Visit "), F.col("g.path"))).alias("goal"))
)
