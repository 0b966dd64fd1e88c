"""Registered queries against the SQL they equal, in DuckDB over sf0.001."""

import math
import os

import duckdb
import pytest

from visitory.plans import catalog, stored  # noqa: F401  stored adds its queries to the catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
#: One or two of each family, to keep the run short.
PICKED = [
    "visits_dense", "visits_compat", "visit_invariants", "agg_per_site", "ts_minute", "ts_week", "main_graph_date", "period_custom", "filter_is_not", "filter_json",
    "bd_page", "bd_pct_device", "bd_page_limit", "exit_pages", "goals", "conversions", "report_countries", "report_referrers", "top_stats_prev", "realtime",
    "rollup_bd_page", "stored_visits", "stored_period_day", "visits_pointers", "streamed_visits", "place_sweep", "streamed_realtime", "compacted_visits", "api_breakdown", "report_city_flags",
    "url_parts", "source_resolve", "bsi_between", "bitmap_distinct", "ingest_faults", "ingest_hits", "place_lookup",
]


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    return f"{float(v):.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("events", "nation", "region", "pages", "orders", "lineitem"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", PICKED)
def test_equals_sql(spark, duck, name):
    made = catalog.QUERIES[name](spark, SF)
    want = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(made.columns)
    rows = [{n: _plain(v) for n, v in zip(names, r, strict=True)} for r in want.fetchall()]
    assert sorted(tuple(r[c] for c in sorted(names)) for r in rows) == sorted(tuple(_plain(r[c]) for c in sorted(names)) for r in made.collect())


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL)
