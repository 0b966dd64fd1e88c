"""The stats API as functions: the same arguments as its routes, DataFrames as results."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame

from ..functions import periods
from ..operators import filters as _filters
from ..operators import metrics as _metrics
from ..operators import shapes, visits

#: What hits get from their visit.
_OF_VISITS = {"session", "bounce", "duration", "entry_page", "exit_page"}


def _visited(hits: DataFrame, site_id: str, names: list[str], filter_text: str = "[]", *props: str) -> DataFrame:
    """The site's hits, with their part in their visit only where a metric, a filter or the property needs it. Stored
    visits and others that have it already are taken as they are."""
    rows = hits.filter(hits["domain"] == site_id)
    asked = {key for _, key, _ in _filters.parse(filter_text)} | {_filters.column(p) for p in props}
    # the host of an event is part of what visits decide
    plain = set(names) <= set(_metrics.PLAIN) and not asked & (_OF_VISITS | {"host"})
    return rows if plain or "session" in hits.columns else visits.visits(rows)


def _selected(hits: DataFrame, site_id: str, period: str, now: datetime, date: str | None, interval: str | None, filter_text: str, names: list[str], *props: str) -> tuple[DataFrame, periods.Period]:
    bounds = periods.period(period, now, date, interval)
    return shapes.select(_visited(hits, site_id, names, filter_text, *props), site_id, bounds, _filters.parse(filter_text)), bounds


def realtime_visitors(hits: DataFrame, site_id: str, now: datetime) -> DataFrame:
    return shapes.realtime(hits.filter(hits["domain"] == site_id), now)


def aggregate(hits: DataFrame, site_id: str, now: datetime, period: str = "30d", date: str | None = None, interval: str | None = None, filters: str = "[]", metrics: str = "visitors", comparison: str | None = None) -> DataFrame:
    """One row; with ``comparison`` each metric is followed by its change."""
    if comparison and period not in ("all", "realtime"):
        bounds = periods.period(period, now, date, interval)
        return shapes.top_stats(_visited(hits, site_id, metrics.split(","), filters), site_id, bounds, comparison, now, _items(filters), names=metrics.split(","))
    rows, _ = _selected(hits, site_id, period, now, date, interval, filters, metrics.split(","))
    return shapes.aggregate(rows, metrics.split(","))


def between(start: str, end: str) -> dict[str, str]:
    """The arguments of a custom period from one day to another, as in ``aggregate(..., **between(a, b))``."""
    return {"period": "custom", "date": f"{start},{end}"}


def timeseries(hits: DataFrame, site_id: str, now: datetime, period: str = "30d", date: str | None = None, interval: str | None = None, filters: str = "[]", metrics: str = "visitors") -> DataFrame:
    rows, bounds = _selected(hits, site_id, period, now, date, interval, filters, metrics.split(","))
    return shapes.timeseries(rows, bounds.interval, metrics.split(","))


def breakdown(hits: DataFrame, site_id: str, property: str, now: datetime, period: str = "30d", date: str | None = None, interval: str | None = None, filters: str = "[]", metrics: str = "visitors", limit: int | None = None, page: int = 1) -> DataFrame:
    if property in ("domain", "event:props") or property.startswith("event:props:"):
        raise ValueError(f"no breakdown by {property}")
    rows, _ = _selected(hits, site_id, period, now, date, interval, filters, metrics.split(","), property)
    return shapes.breakdown(rows, property, metrics.split(","), limit, (page - 1) * (limit or 0))


def _items(text: str) -> list:
    return _filters.parse(text)
