"""Periods, buckets, filters, scalars and user agents."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from visitory.functions import agent, buckets, periods, scalar
from visitory.operators import filters, lookups, metrics, shapes
from visitory.plans import catalog

NOW = datetime(2024, 8, 15, 10, 20, 30)


def test_periods():
    p = periods.period("7d", NOW, "2024-08-15")
    assert (p.start, p.end, p.interval) == (datetime(2024, 8, 9), datetime(2024, 8, 15, 23, 59, 59, 999999), "date")
    p = periods.period("6mo", NOW, "2024-02-29")
    assert (p.start, p.end) == (datetime(2023, 9, 1), datetime(2024, 2, 29, 23, 59, 59, 999999))
    assert periods.year_end(datetime(2024, 1, 1).date()) == datetime(2024, 12, 31, 23, 59, 59, 999999)
    assert periods.period("realtime", NOW).start == datetime(2024, 8, 15, 10, 5)
    assert periods.starts(periods.period("month", NOW, "2024-02-03", "week"))[0] == datetime(2024, 1, 28)
    for bad in (("nope", None), ("custom", "2024-01-02"), ("day", "yesterday")):
        with pytest.raises(ValueError):
            periods.period(bad[0], NOW, bad[1])
    with pytest.raises(ValueError):
        periods.compared(p, "custom", NOW)
    assert periods.compared(periods.period("year", datetime(2024, 2, 29), "2024-02-29"), "year_over_year", datetime(2024, 2, 29)).end == datetime(2023, 2, 28)


def test_sunday_weeks_and_range_modes(spark):
    df = spark.createDataFrame([(datetime(2024, 7, 21, 5),), (datetime(2024, 7, 20, 23),)], "ts timestamp_ntz")
    assert [r[0] for r in df.select(buckets.label(buckets.bucket(F.col("ts"), "week"), "week")).collect()] == ["2024-07-21", "2024-07-14"]
    hours = spark.createDataFrame([(datetime(2024, 1, 1) + timedelta(hours=h),) for h in range(26)], "ts timestamp_ntz")
    p = periods.period("day", NOW, "2024-01-01")
    assert hours.filter(periods.within(p)).count() == 24
    assert hours.filter(periods.within(p, mode="compat")).agg(F.min("ts"), F.max("ts")).first()[:] == (datetime(2024, 1, 1, 1), datetime(2024, 1, 2))


def test_filters(spark):
    assert filters.parse('[["is","event:page",["/:dashboard","/sites"]],["is","visit:utm_source",["Twitter"]]]') == [("is", "page", ["/:dashboard", "/sites"]), ("is", "utm_source", ["Twitter"])]
    assert filters.parse('[["is","event:goal",["Visit /a"]],["x"],["is","visit:city",[7]]]') == [("is", "page", ["/a"]), ("is", "city", ["7"])]
    for bad in (("is", "event:props:x", ["a"]), ("like", "page", ["a"]), ("contains", "city", ["1"])):
        with pytest.raises(ValueError):
            filters.condition(*bad)
    with pytest.raises(Exception):
        filters.condition("matches", "page", ["("])
    df = spark.createDataFrame([("a",), ("b",), (None,)], "page string")
    count = lambda *i: df.filter(filters.condition(*i)).count()
    assert (count("is_not", "page", ["a"]), count("does_not_match", "page", ["^a.*"]), count("does_not_contain", "page", ["z"]), count("is", "page", ["zz"])) == (1, 1, 2, 0)


def test_metrics_refuse_unknown_and_divide_by_no_visits(spark):
    with pytest.raises(ValueError):
        metrics.check(["time_on_page"])
    hits = spark.createDataFrame([(1, False, True, 0, 5_000_000)], "id long, session boolean, view boolean, bounce int, duration long")
    row = metrics.measure(hits, [], metrics.NAMES).first()
    assert (row.views_per_visit, row.bounce_rate, row.visit_duration) == (1, 0, 5)
    empty = metrics.measure(hits.limit(0), [], metrics.NAMES).first()
    assert (empty.visitors, empty.views_per_visit, empty.visit_duration) == (0, 0, 0)


def test_scalars(spark):
    def one(col, **row):
        return spark.range(1).select(*[F.lit(v).alias(k) for k, v in row.items()]).select(col.alias("x")).first().x

    assert one(scalar.clean_referrer(F.col("r")), r="www.a.org/") == "https://a.org"
    assert one(scalar.clean_referrer(F.col("r")), r="  ") is None
    assert one(scalar.clean_domain(F.col("d")), d=" https://www.Example.com/ ") == "example.com"
    assert one(scalar.page_path(F.col("u"), F.lit(1)), u="https://a.b/x#y") == "/x#y"
    assert one(scalar.url_part(F.col("u"), "HOST"), u="no url at all") is None
    assert one(scalar.address_number(F.col("a")), a="1.0.16.0") == 16781312
    headers = F.create_map(F.lit("x-forwarded-for"), F.lit("9.9.9.9, 1.1.1.1"))
    assert one(scalar.client_address(headers, F.col("r")), r="8.8.8.8:80") == "9.9.9.9"
    assert one(scalar.client_address(F.create_map(F.lit("a"), F.lit("b")), F.col("r")), r="nonsense") == "-"
    assert one(lookups.flag(F.lit("IT")), r=1) == "\U0001f1ee\U0001f1f9"
    import zlib

    assert one(scalar.visitor_id(F.lit("1.2.3.4"), F.lit("ua"), F.lit("d"), F.lit(None).cast("string")), r=1) == zlib.crc32(b"1.2.3.4uad")


def test_agents(spark):
    rows = spark.createDataFrame([(a[0],) for a in catalog.AGENTS] + [(None,)], "user_agent string")
    got = {r.user_agent: (r.browser, r.browser_version, r.os, r.os_version, r.device, r.bot) for r in agent.parsed(rows).collect()}
    for a in catalog.AGENTS:
        assert got[a[0]][5] if a[1] is None else got[a[0]] == (*a[1:6], False)
    assert got[None] == (None, None, None, None, None, False)


def test_sources(spark):
    rows = spark.createDataFrame([("https://mail.126.com/x", ""), ("https://own.org", "mine"), (None, None)], "referrer string, utm string")
    assert [r.source for r in lookups.with_source(rows, "referrer", {"a": F.col("utm")}).collect()] == ["126 Mail", "mine", None]


def test_breakdown_leaves_out_null(spark):
    hits = spark.createDataFrame([(1, "a", True), (2, None, True)], "id long, page string, view boolean")
    assert [tuple(r) for r in shapes.breakdown(hits, "page").collect()] == [("a", 1.0)]
    with pytest.raises(ValueError):
        shapes.breakdown(hits, "event:props:x")


def test_goal_filters_keep_every_value(spark):
    hits = spark.createDataFrame([(1, "signup", "/a"), (2, "purchase", "/a"), (3, None, "/x"), (4, "other", "/y"), (5, "signup", "/x"), (6, None, None)], "k int, event string, page string")

    def found(op, *goals):
        items = filters.parse(json.dumps([[op, "event:goal", list(goals)]]))
        return [r.k for r in hits.filter(filters.all_of(items)).orderBy("k").collect()]

    assert found("is", "signup", "purchase") == [1, 2, 5]
    assert found("is", "Visit /x", "Visit /y") == [3, 4, 5]
    assert found("is", "purchase", "Visit /x") == [2, 3, 5]
    assert found("is_not", "signup", "purchase") == [4]
    assert found("is_not", "purchase", "Visit /x") == [1, 4]
    assert found("contains", "purch", "Visit /y") == [2, 4]
