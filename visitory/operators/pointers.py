"""The starts of visits in long stretches, without going through a stretch in order.

From any instant the next visit would begin at the first instant 15 minutes or more later: its pointer. Pointers are
found by hour, in a sweep over the hour's instants and the points 15 minutes after instants; in a stretch without a pause
the answer is never more than 15 minutes behind the point, so an hour needs its own instants and those of the next.
The starts are those instants that pointers lead to from the stretch's first. Pointers are squared in rounds (to the
second next start, the fourth, ...), and then, from the longest jump down, all starts found so far jump once: after so
many rounds as the number of visits has bits, every start is found. Each round is a join by instant, dealt over all tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources import work

KEY = ["domain", "id"]
HOUR = 3_600_000_000


def next_starts(instants: DataFrame, window_us: int) -> DataFrame:
    """(domain, id, _stretch, at, to) of instants (domain, id, _stretch, _us): the first instant of the stretch ``window_us``
    or more later, null at its end. ``window_us`` is an hour at most, and no pause in a stretch is as long."""
    key = [*KEY, "_stretch"]
    hour = F.floor(F.col("_us") / HOUR)
    # an instant answers points of its own hour and of the one before
    answers = instants.select(*key, F.explode(F.array(hour, hour - 1)).alias("hour"), F.col("_us").alias("p"), F.col("_us").alias("to"), F.lit(None).cast("long").alias("at"))
    point = F.col("_us") + window_us
    asked = instants.select(*key, F.floor(point / HOUR).alias("hour"), point.alias("p"), F.lit(None).cast("long").alias("to"), F.col("_us").alias("at"))
    # from late to early, with an instant before the points that it answers
    order = Window.partitionBy(*key, "hour").orderBy(F.desc("p"), F.col("to").isNull())
    swept = answers.unionByName(asked).withColumn("to", F.last("to", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return swept.filter("at is not null").select(*key, "at", "to")


def starts(instants: DataFrame, window_us: int) -> DataFrame:
    """(domain, id, _stretch, visit_start) of all visits of the stretches ``instants`` (domain, id, _stretch, _us; distinct)."""
    key = [*KEY, "_stretch"]
    longest = instants.groupBy(*key).agg((F.max("_us") - F.min("_us")).alias("span")).agg(F.max("span")).first()[0]
    found = instants.select(*key, F.col("_stretch").alias("visit_start")).distinct()
    if longest is None:
        return found
    jumps = [work.written(next_starts(instants, window_us).filter("to is not null"), "jumps")]
    while 2 ** len(jumps) <= longest // window_us:
        last = jumps[-1]
        on = last.select(*key, F.col("at").alias("to"), F.col("to").alias("on"))
        jumps.append(work.written(last.join(on, [*key, "to"]).select(*key, "at", F.col("on").alias("to")), "jumps"))
    for jump in reversed(jumps):
        led = found.withColumnRenamed("visit_start", "at").join(jump, [*key, "at"]).select(*key, F.col("to").alias("visit_start"))
        found = work.written(found.unionByName(led), "starts")
    return found


def placed(instants: DataFrame, window_us: int) -> DataFrame:
    """(domain, id, _us, visit_start) of every instant. In such a stretch a visit begins at least every two windows, so
    the starts of an instant's hour and of the hour before are enough."""
    hour = F.floor(F.col("visit_start") / HOUR)
    near = starts(instants, window_us).select(*KEY, F.explode(F.array(hour, hour + 1)).alias("_hour"), "visit_start")
    near = near.groupBy(*KEY, "_hour").agg(F.collect_list("visit_start").alias("_starts"))
    at = instants.select(*KEY, "_us", "_stretch", F.floor(F.col("_us") / HOUR).alias("_hour")).join(near, [*KEY, "_hour"])
    return at.select(*KEY, "_us", F.array_max(F.filter("_starts", lambda s: s <= F.col("_us"))).alias("visit_start"))
