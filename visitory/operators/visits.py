"""Visits: a hit opens a new visit when 15 minutes or more have passed since the start of the visitor's last one.

The window is anchored at the visit's first hit, so a gap rule does not find it. Yet a pause of 15 minutes always opens
a visit, whatever came before, so pauses cut a visitor's hits into stretches that are worked out apart. The steps:

1. The distinct instants are gathered by (site, visitor, hour), so a visitor with very many hits is spread over the
   hours. Inside an hour the pauses are seen directly; a small row for each hour carries the last instant and the open
   stretch over to the next hour.
2. A stretch shorter than the window is one visit. Longer ones are folded over their distinct instants, or, where they
   have very many, found by pointers (:mod:`.pointers`) that spread over all tasks.
3. Hits take the start of their visit, and windows over the visit give first hit, second hit and the time since the
   last hit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources import work
from . import pointers

WINDOW_US = 15 * 60 * 1_000_000
KEY = ["domain", "id"]


def _micros(ts: str | Column) -> Column:
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def visit_starts(hits: DataFrame, window_us: int = WINDOW_US, most: int | None = None) -> DataFrame:
    """``hits`` (domain, id, seq, ts and any others) with ``visit_start``, the instant in microseconds.

    Stretches of more than ``most`` instants are worked out by pointers; whether there are any takes a job of its own.
    Without ``most`` all stretches are folded and nothing runs before the result is asked for.

    The starts are worked out on (site, visitor, instant) alone and joined to the hits at the end, so the hits' other
    columns move only then. Hits without a site, visitor or time are left out.
    """
    at = hits.withColumn("_us", _micros("ts"))
    hours = at.groupBy(*KEY, F.floor(F.col("_us") / 3_600_000_000).alias("_hour")).agg(F.array_sort(F.collect_set("_us")).alias("_all"))
    after_pause = F.filter("_all", lambda x, k: F.coalesce(x - F.get("_all", k - 1) >= window_us, F.lit(False)))
    # a small row for each hour: its ends, and at most four instants that follow a pause inside it
    ends = hours.select(*KEY, "_hour", F.element_at("_all", 1).alias("_first"), F.element_at("_all", -1).alias("_last"), after_pause.alias("_inside"))
    order = Window.partitionBy(*KEY).orderBy("_hour")
    before = F.lag("_last").over(order)
    opens = F.when(before.isNull() | (F.col("_first") - before >= window_us), F.array("_first")).otherwise(F.array().cast("array<bigint>"))
    ends = ends.withColumn("_opens", F.concat(opens, "_inside"))
    newest = F.when(F.size("_opens") > 0, F.element_at("_opens", -1))
    carried = F.last(newest, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select(*KEY, "_hour", "_opens", carried.alias("_carried"))
    instants = hours.join(ends, [*KEY, "_hour"]).select(*KEY, F.explode("_all").alias("_us"), "_opens", "_carried")
    stretch = F.coalesce(F.array_max(F.filter("_opens", lambda s: s <= F.col("_us"))), "_carried")
    instants = instants.select(*KEY, "_us", stretch.alias("_stretch"))
    long = None
    if most is not None:
        instants = work.written(instants, "instants")
        many = work.written(instants.groupBy(*KEY, "_stretch").count().filter(F.col("count") > most).select(*KEY, "_stretch"), "long-stretches")
        if many.limit(1).count():
            long = pointers.placed(work.written(instants.join(many, [*KEY, "_stretch"], "left_semi"), "long-instants"), window_us)
            instants = instants.join(many, [*KEY, "_stretch"], "left_anti")
    stretches = instants.groupBy(*KEY, "_stretch").agg(F.array_sort(F.collect_list("_us")).alias("_all"))

    def step(starts: Column, us: Column) -> Column:
        return F.when(us - F.element_at(starts, -1) >= window_us, F.concat(starts, F.array(us))).otherwise(starts)

    starts = F.when(F.element_at("_all", -1) - F.col("_stretch") < window_us, F.array("_stretch")).otherwise(F.aggregate("_all", F.array("_stretch"), step))
    # starts stand before the instants that follow them: one sorted pass, however many visits a stretch has
    marked = F.concat(F.transform(starts, lambda u: F.struct(u.alias("_us"), F.lit(0).alias("_k"))), F.transform("_all", lambda u: F.struct(u.alias("_us"), F.lit(1).alias("_k"))))
    marked = stretches.select(*KEY, "_stretch", F.inline(marked))
    in_stretch = Window.partitionBy(*KEY, "_stretch").orderBy("_us", "_k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    newest = F.last(F.when(F.col("_k") == 0, F.col("_us")), ignorenulls=True).over(in_stretch)
    placed = marked.withColumn("visit_start", newest).filter("_k = 1").select(*KEY, "_us", "visit_start")
    placed = placed if long is None else placed.unionByName(long)
    return at.join(placed, [*KEY, "_us"])


def visits(hits: DataFrame, window_us: int = WINDOW_US, compat: bool = False, most: int | None = None, once: bool = False) -> DataFrame:
    """Every hit with what it adds to its visit:

    session (true on the first hit), bounce (1, then -1 on the second hit, then 0), duration (microseconds since the
    visit's last hit), entry_page, exit_page and host (null for events). ``true_exit_page`` is the page of the visit's
    last view. Figures of any group of hits are sums over its rows; they are never joined from the visit.

    With ``once`` a hit that comes again (same site, visitor, time and number) is dropped; this takes no move of its own, as
    equal hits stand side by side in their visit. For ``most`` see :func:`visit_starts`. With ``compat`` a visit that follows another of the same visitor takes no entry and exit page from its first hit.
    """
    rows = visit_starts(hits, window_us, most)
    visit = Window.partitionBy(*KEY, "visit_start")
    order = visit.orderBy("_us", "seq")
    if once:
        again = (F.lag("_us").over(order) == F.col("_us")) & F.lag("seq").over(order).eqNullSafe(F.col("seq"))
        rows = rows.withColumn("_twice", F.coalesce(again, F.lit(False))).filter("not _twice").drop("_twice")
    number = F.row_number().over(order)
    seen = F.when(F.col("view"), F.col("page"))
    first = F.first(seen).over(order)
    entry, leave, host = F.coalesce(first, seen), F.coalesce(seen, first), F.when(F.col("view"), F.col("host"))
    if compat:
        rows = rows.withColumn("_again", F.col("visit_start") > F.min("_us").over(Window.partitionBy(*KEY)))
        again, opens = F.col("_again"), number == 1
        entry = F.when(again, F.when(~opens, seen)).otherwise(entry)
        leave = F.when(again, F.when(~opens, seen)).otherwise(leave)
        host = F.when(again & opens, F.col("host")).otherwise(host)
    last_view = F.last(seen, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.withColumns(
        {
            "session": number == 1,
            "bounce": F.when(number == 1, 1).when(number == 2, -1).otherwise(0),
            "duration": F.coalesce(F.col("_us") - F.lag("_us").over(order), F.lit(0)).cast("long"),
            "entry_page": entry,
            "exit_page": leave,
            "true_exit_page": last_view,
            "host": host,
        }
    ).drop("_us", "_again")
