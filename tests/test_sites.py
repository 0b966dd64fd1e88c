"""Sites and goals, city ids, the API functions and the hit store."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from visitory.functions import periods
from visitory.operators import lookups, metrics, shapes, visits
from visitory.plans import api
from visitory.schema import SITE
from visitory.sources import sites, store


def test_sites_and_goals(spark):
    table = sites.create(spark.createDataFrame([], SITE), ["https://www.A.org/", "a.org", "bad name?"])
    assert [r.domain for r in table.collect()] == ["a.org"]
    table = sites.add_goal(sites.add_goal(sites.add_goal(table, "a.org", name="signup"), "a.org", path="/x"), "a.org", name="signup")
    assert [(r.name, r.path) for r in sites.goals(table).collect()] == [("signup", None), (None, "/x")]
    assert [(r.name, r.path) for r in sites.goals(sites.delete_goal(table, "a.org", 0)).collect()] == [(None, "/x")]
    assert sites.delete(table, "a.org").count() == 0
    for bad in ({}, {"name": "a", "path": "/b"}, {"path": "b"}):
        with pytest.raises(ValueError):
            sites.add_goal(table, "a.org", **bad)


def test_city_ids(spark):
    cities = spark.createDataFrame([("IT", "Rome", 3169070), ("US", "Rome", 1)], "country string, name string, city int")
    rows = spark.createDataFrame([("IT", "Rome"), ("IT", "Nowhere"), (None, None)], "country string, city_name string")
    assert [r.city for r in lookups.with_city_id(rows, cities).collect()].count(3169070) == 1


def test_api(spark):
    now = datetime(2024, 1, 1, 12)
    hits = spark.createDataFrame(
        [("a.org", 1, 1, datetime(2024, 1, 1, 11, 58), True, None, "/x", "a.org"), ("a.org", 2, 2, datetime(2024, 1, 1, 3), True, None, "/y", "a.org")],
        "domain string, id long, seq long, ts timestamp_ntz, view boolean, event string, page string, host string",
    )
    hits = visits.visits(hits)
    assert api.realtime_visitors(hits, "a.org", now).first().visitors == 1
    assert api.aggregate(hits, "a.org", now, "day", metrics="visitors,pageviews").first()[:] == (2.0, 2.0)
    assert api.aggregate(hits, "a.org", now, "day", filters='[["is","event:page",["/y"]]]').first().visitors == 1
    assert api.aggregate(hits, "a.org", now, "day", comparison="previous_period").first().visitors_change == 100
    assert [r.timestamp for r in api.timeseries(hits, "a.org", now, "day").collect()] == ["2024-01-01 03:00:00", "2024-01-01 11:00:00"]
    assert [r.page for r in api.breakdown(hits, "a.org", "event:page", now, "day", limit=1, page=2).collect()] == ["/y"]
    with pytest.raises(ValueError):
        api.breakdown(hits, "a.org", "event:props:x", now)


def test_api_periods_and_comparison(spark):
    now = datetime(2024, 1, 5, 12)
    rows = [("a.org", k, k, datetime(2024, 1, 1 + k, 3), True, None, "/x", "a.org") for k in range(4)]
    hits = visits.visits(spark.createDataFrame(rows, "domain string, id long, seq long, ts timestamp_ntz, view boolean, event string, page string, host string"))
    assert api.aggregate(hits, "a.org", now, **api.between("2024-01-02", "2024-01-03")).first().visitors == 2
    got = api.aggregate(hits, "a.org", now, **api.between("2024-01-03", "2024-01-04"), metrics="pageviews,visitors", comparison="previous_period").first()
    assert got.asDict() == {"pageviews": 2.0, "pageviews_change": 0.0, "visitors": 2.0, "visitors_change": 0.0}


def test_store_prunes_days_and_sites(spark, tmp_path):
    path = str(tmp_path / "hits")
    rows = [(f"{s}.org", k, k, datetime(2024, 1, 1 + k, 3), True, None, "/x", "a.org") for s in "ab" for k in range(4)]
    hits = visits.visits(spark.createDataFrame(rows, "domain string, id long, seq long, ts timestamp_ntz, view boolean, event string, page string, host string"))
    store.write(hits, path)
    kept = store.read(spark, path)
    two = shapes.select(kept, "a.org", periods.period("custom", datetime(2024, 1, 9), "2024-01-02,2024-01-03"))
    assert metrics.measure(two, [], ["visitors", "visits"]).first()[:] == (2.0, 2.0)
    plan = two._jdf.queryExecution().executedPlan().toString()
    pruned = plan[plan.index("PartitionFilters") : plan.index("PushedFilters")]
    assert "day" in pruned and "domain" in pruned


def test_a_busy_site_is_spread(spark):
    """All hits are of one site: its admission still deals them over all tasks, and equal hits all stay."""
    hits = spark.range(1000).selectExpr("if(id % 10 = 0, 'b', 'a') as domain", "id % 500 as k", "map('x', id) as more")
    hits = hits.unionByName(spark.range(1).selectExpr("cast(null as string) as domain", "id as k", "map('x', id) as more"))
    sites = spark.createDataFrame([("a",), ("a",), ("z",)], "domain string")
    kept = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in kept}
    try:
        for k, v in kept.items():
            spark.conf.set(k, v)
        made = lookups.known_sites(hits, sites)
        assert made.count() == 900 and made.columns == hits.columns
        assert made.select(F.spark_partition_id()).distinct().count() == 4
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
