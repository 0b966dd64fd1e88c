"""Stored visits that are kept up as hits come in, in any order and more than once.

The store holds every hit with its part in its visit, by site and day. A load of new hits changes only the stretches of
their visitors (runs of hits without a pause of the length of a visit): a stretch with a new hit is worked out again, all
others stay, and only the folders of days that hold a changed stretch are written anew, by dynamic overwrite.

The days that are read are those of the new hits and some around them. Where a changed stretch reaches the edge of what
was read without a pause, more days are read, so the result is that of one load of all hits. A hit that is there already
(same site, visitor, time and number) adds nothing: a load that is run again, whole or after a failure, repairs the store.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import visits
from . import work

HIT_KEY = ["domain", "id", "ts", "seq"]
#: What :func:`visits.visits` adds; ``sent_host`` keeps the hit's own host.
ADDED = ["visit_start", "session", "bounce", "duration", "entry_page", "exit_page", "true_exit_page"]
SALTS = 8
#: Stretches of more instants are worked out by pointers.
MOST = 100_000


def read(spark: SparkSession, path: str) -> DataFrame:
    """The stored hits with their visits and ``day``; bounds on domain and day prune folders."""
    return spark.read.parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _put(rows: DataFrame, path: str) -> None:
    """Writes whole days; days that ``rows`` does not have stay as they are."""
    rows = rows.withColumn("day", F.to_date("ts"))
    rows = rows.repartition("domain", "day", F.pmod(F.xxhash64("id"), F.lit(SALTS))).sortWithinPartitions("domain", "day", "ts")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("domain", "day").parquet(path)


def _visited(hits: DataFrame) -> DataFrame:
    return visits.visits(hits.withColumn("sent_host", F.col("host")), most=MOST, once=True)


def _stretches(instants: DataFrame, window_us: int) -> DataFrame:
    """(domain, id, first, last, new_first, new_last): the stretches with a new hit among ``instants`` (domain, id, us, new),
    and the ends of their new hits."""
    order = Window.partitionBy("domain", "id").orderBy("us")
    opens = F.coalesce(F.col("us") - F.lag("us").over(order) >= window_us, F.lit(True))
    numbered = instants.withColumn("opens", opens.cast("int")).withColumn("stretch", F.sum("opens").over(order))
    new = F.when(F.col("new"), F.col("us"))
    found = numbered.groupBy("domain", "id", "stretch").agg(F.min("us").alias("first"), F.max("us").alias("last"), F.min(new).alias("new_first"), F.max(new).alias("new_last"))
    return found.filter("new_first is not null").drop("stretch")


def add(hits: DataFrame, path: str, window_us: int = visits.WINDOW_US) -> int:
    """Adds hits to the store at ``path``, which is made if it is not there. Returns how many rounds of reading it took.

    Hits without a site, visitor or time are left out, as by :func:`visits.visits`. Nothing is stored for an empty load.
    """
    spark = hits.sparkSession
    plain = hits.columns
    fresh = work.written(hits.filter("domain is not null and id is not null and ts is not null"), "fresh-hits")
    if not _exists(spark, path):
        _put(_visited(fresh), path)
        return 0
    span = fresh.agg(F.min(F.to_date("ts")).alias("low"), F.max(F.to_date("ts")).alias("high")).first()
    if span["low"] is None:
        return 0
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    day_of = F.floor(F.col("us") / 86_400_000_000)
    news = fresh.select("domain", "id", us.alias("us")).distinct()
    people = fresh.select("domain", "id").distinct()
    around, rounds = 1, 0
    while True:
        rounds += 1
        # the days of new hits and `around` days on either side; the bounds prune folders whatever the join does
        days = fresh.select("domain", F.to_date("ts").alias("new_day")).distinct()
        days = days.select("domain", F.explode(F.sequence(F.date_sub("new_day", around), F.date_add("new_day", around))).alias("day")).distinct()
        near = read(spark, path).filter(F.col("day").between(F.date_sub(F.lit(span["low"]), around), F.date_add(F.lit(span["high"]), around)))
        near = near.join(days, ["domain", "day"], "left_semi")
        instants = near.join(people, ["domain", "id"], "left_semi").select("domain", "id", us.alias("us")).distinct().withColumn("new", F.lit(False)).unionByName(news.withColumn("new", F.lit(True)))
        instants = instants.groupBy("domain", "id", "us").agg(F.max("new").alias("new"))
        changed = work.written(_stretches(instants, window_us), "changed-stretches")
        # a stretch that goes on from the first or to the last day that was read may go on beyond
        day = 86_400_000_000
        early = (F.floor(F.col("new_first") / day) - F.floor(F.col("first") / day) >= around) & (F.pmod("first", F.lit(day)) < window_us)
        late = (F.floor(F.col("last") / day) - F.floor(F.col("new_last") / day) >= around) & (F.pmod("last", F.lit(day)) >= day - window_us)
        if changed.filter(early | late).limit(1).count() == 0:
            break
        around *= 2

    # stretches by hour: an hour has five at most, so a row is compared with few however many its visitor has
    hour_us = 3_600_000_000
    by_hour = changed.withColumn("hour", F.explode(F.sequence(F.floor(F.col("first") / hour_us), F.floor(F.col("last") / hour_us))))

    def inside(rows: DataFrame) -> DataFrame:
        """The rows that lie in a changed stretch; a visitor's stretches do not overlap, so a row meets one at most."""
        a, b = rows.withColumn("us", us).withColumn("hour", F.floor(F.col("us") / hour_us)).alias("a"), by_hour.alias("b")
        met = a.join(b, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("domain", "id", "hour")] + [F.col("a.us").between(F.col("b.first"), F.col("b.last"))], "left")
        return met.select("a.*", F.col("b.first").isNotNull().alias("changed")).drop("us", "hour")

    old = near.select(*[F.col("sent_host").alias("host") if c == "host" else F.col(c) for c in plain])
    old = inside(old).filter("changed").drop("changed")
    # a stretch has no pause, so it has hits on every day from its first to its last
    day_at = [F.to_date(F.timestamp_micros(c)) for c in ("first", "last")]
    touched = work.written(changed.select("domain", F.explode(F.sequence(*day_at)).alias("day")).distinct(), "changed-days")
    bounds = touched.agg(F.min("day").alias("low"), F.max("day").alias("high")).first()
    kept = read(spark, path).filter(F.col("day").between(F.lit(bounds["low"]), F.lit(bounds["high"]))).join(touched, ["domain", "day"], "left_semi")
    kept = inside(kept).filter(~F.col("changed")).drop("changed", "day")
    # what has changed goes straight to its days: nothing of all columns is written but the days themselves
    _put(kept.unionByName(_visited(old.unionByName(fresh))), path)
    return rounds
