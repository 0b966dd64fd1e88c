"""Places of addresses, IPv4 and IPv6, by ranges that may lie inside or across each other: the narrowest one counts.

An address is 128 bits as two longs that sort like it; an IPv4 address is the IPv6 address that stands for it. Nothing is
broadcast and no range is cut by fixed blocks, so a default route costs no more than any other range:

1. All bounds, in order, cut the addresses into pieces. A range covers pieces from one rank to another, which are a few
   nodes of a binary tree over the ranks. A piece lies below as many nodes as the tree is deep, and takes the narrowest
   range among theirs.
2. Different addresses and the starts of pieces are swept in order, in range partitions: an address takes the last piece
   before it, or that of an earlier partition.
3. Rows meet their address' place by an ordinary join, which Spark splits where one address has very many rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources import work

PLACE = ["country", "subdivision1_code", "city"]
_V4 = r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$"
_SIGN = -(1 << 63)


def _signed(hexadecimal: Column) -> Column:
    """Sixteen hexadecimal digits as a long that sorts like them."""
    return F.conv(hexadecimal, 16, -10).cast("long").bitwiseXOR(F.lit(_SIGN))


def bits(address: Column) -> Column:
    """struct(hi, lo) of an address text; null for what is no address. An IPv4 tail in an IPv6 address is understood, a
    zone behind % is left out."""
    text = F.lower(F.regexp_replace(F.trim(address), r"%.*$", ""))
    octets = [F.regexp_extract(text, _V4, k).try_cast("int") for k in range(1, 5)]
    short = octets[0] < 256
    for o in octets[1:]:
        short = short & (o < 256)
    four = F.concat(F.lit("00000000000000000000ffff"), *[F.lpad(F.hex(o), 2, "0") for o in octets])
    # an IPv4 tail becomes two groups
    tail = [F.regexp_extract(text, r"^.*:(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$", k).try_cast("int") for k in range(1, 5)]
    fine_tail = (tail[0] < 256) & (tail[1] < 256) & (tail[2] < 256) & (tail[3] < 256)
    two = F.concat(F.regexp_extract(text, r"^(.*:)[\d.]+$", 1), F.lower(F.hex(tail[0] * 256 + tail[1])), F.lit(":"), F.lower(F.hex(tail[2] * 256 + tail[3])))
    text6 = F.when(text.contains("."), F.when(fine_tail, two)).otherwise(text)
    halves = F.split(text6, "::", -1)
    groups = [F.filter(F.split(F.get(halves, k), ":", -1), lambda g: g != "") for k in range(2)]
    left, right = groups[0], F.coalesce(groups[1], F.array().cast("array<string>"))
    lacking = 8 - F.size(left) - F.size(right)
    well = ((F.size(halves) == 1) & (lacking == 0)) | ((F.size(halves) == 2) & (lacking >= 1))
    well = well & text6.rlike(r"^[0-9a-f:]+$") & ~text6.rlike(r"[0-9a-f]{5}|:::|^:[^:]|[^:]:$")
    zeros = F.array_repeat(F.lit("0"), F.greatest(lacking, F.lit(0)))
    eight = F.array_join(F.transform(F.concat(left, zeros, right), lambda g: F.lpad(g, 4, "0")), "")
    digits = F.when(short, F.lower(four)).when(text6.contains(":") & well, eight)
    return F.when(digits.isNotNull(), F.struct(_signed(F.substring(digits, 1, 16)).alias("hi"), _signed(F.substring(digits, 17, 16)).alias("lo")))


def _next(at: Column) -> Column:
    """The address behind ``at``; null behind the last."""
    wraps = at["lo"] == (1 << 63) - 1
    after = F.struct(F.when(wraps, at["hi"] + 1).otherwise(at["hi"]).alias("hi"), F.when(wraps, F.lit(_SIGN)).otherwise(at["lo"] + 1).alias("lo"))
    return F.when(~(wraps & (at["hi"] == (1 << 63) - 1)), after)


def _ranked(rows: DataFrame, by: str) -> DataFrame:
    """``rows`` with ``rank``, from 0 in the order of ``by`` (distinct): by range partitions and their sizes."""
    parts = work.written(rows.repartitionByRange(F.col(by)).withColumn("_part", F.spark_partition_id()), "ranked")
    sizes = parts.groupBy("_part").count()
    first = sizes.select("_part", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_first"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(by))
    return parts.withColumn("_inside", inside).join(first, "_part").withColumn("rank", F.col("_first") + F.col("_inside") - 1).drop("_part", "_inside", "_first")


def pieces(ranges: DataFrame) -> DataFrame:
    """(start, place) of disjoint pieces, each up to the start of the next, from ranges (low, high: addresses as text;
    country, subdivision1_code, city); place is null where no range is. Ranges with a bound that is no address, or that
    end before they begin, are left out. Of equally narrow ranges the one with the lower start counts, then the lesser place."""
    held = ranges.select(bits(F.col("low")).alias("low"), bits(F.col("high")).alias("high"), F.struct(*PLACE).alias("place"))
    held = work.written(held.filter("low is not null and high is not null and low <= high").withColumn("after", _next(F.col("high"))), "ranges")
    edges = held.select(F.col("low").alias("at")).unionByName(held.filter("after is not null").select(F.col("after").alias("at"))).distinct()
    edges = work.written(_ranked(edges, "at"), "edges")
    n = edges.count()
    depth = max(1, n - 1).bit_length() if n else 1
    base = 1 << depth
    placed = held.join(edges.select(F.col("at").alias("low"), F.col("rank").alias("first")), "low")
    placed = placed.join(edges.select(F.col("at").alias("after"), F.col("rank").alias("last")), "after", "left").withColumn("last", F.coalesce("last", F.lit(n).cast("long")))

    def step(state: Column, _: Column) -> Column:
        a, b, nodes = state["a"], state["b"], state["nodes"]
        some = a < b
        here = F.when(some & (a % 2 == 1), F.array(a)).otherwise(F.array().cast("array<bigint>"))
        there = F.when(some & (b % 2 == 1), F.array(b - 1)).otherwise(F.array().cast("array<bigint>"))
        halved = F.when(a % 2 == 1, (a + 1) / 2).otherwise(a / 2).cast("long")
        return F.struct(halved.alias("a"), F.floor(b / 2).cast("long").alias("b"), F.concat(nodes, here, there).alias("nodes"))

    start = F.struct((F.col("first") + base).cast("long").alias("a"), (F.col("last") + base).cast("long").alias("b"), F.array().cast("array<bigint>").alias("nodes"))
    cover = F.aggregate(F.sequence(F.lit(0), F.lit(depth)), start, step, lambda x: x["nodes"])
    # widths as two whole numbers of 64 bits, by decimals, which hold differences of longs
    high, low = ({x: F.col(f"{c}.{x}").cast("decimal(20,0)") for x in ("hi", "lo")} for c in ("high", "low"))
    borrow = F.when(high["lo"] < low["lo"], 1).otherwise(0)
    width = F.struct((high["hi"] - low["hi"] - borrow).alias("w1"), (high["lo"] - low["lo"] + borrow * F.lit(1 << 32).cast("decimal(20,0)") * F.lit(1 << 32)).alias("w2"))
    order = F.struct(width.alias("width"), F.col("low"), F.to_json("place").alias("name"))
    nodes = placed.select(F.explode(cover).alias("node"), order.alias("order"), "place")
    nodes = nodes.groupBy("node").agg(F.min_by(F.struct("order", "place"), "order").alias("best"))
    above = edges.select("at", F.explode(F.transform(F.sequence(F.lit(0), F.lit(depth)), lambda k: F.call_function("shiftright", (F.col("rank") + base).cast("long"), k))).alias("node"))
    best = above.join(nodes, "node", "left").groupBy("at").agg(F.min_by("best.place", "best.order").alias("place"))
    return best.select(F.col("at").alias("start"), "place")


def located(addresses: DataFrame, cut: DataFrame) -> DataFrame:
    """(at, place) of different addresses ``at`` by the pieces ``cut`` (start, place)."""
    known = cut.select(F.col("start").alias("at"), F.lit(0).alias("asks"), F.struct("place").alias("piece"))
    asked = addresses.select("at", F.lit(1).alias("asks"), F.lit(None).cast(known.schema["piece"].dataType).alias("piece"))
    both = work.written(known.unionByName(asked).repartitionByRange("at", "asks").withColumn("part", F.spark_partition_id()), "sweep")
    order = Window.partitionBy("part").orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = both.withColumn("own", F.last("piece", ignorenulls=True).over(order))
    # the last piece of each partition, carried over those without any; a row for each partition
    ends = both.filter("asks = 0").groupBy("part").agg(F.max_by("piece", "at").alias("end"))
    every = both.select("part").distinct().join(ends, "part", "left")
    carried = F.last("end", ignorenulls=True).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return swept.filter("asks = 1").join(every.select("part", carried.alias("before")), "part").select("at", F.coalesce("own", "before")["place"].alias("place"))


def with_place(rows: DataFrame, ranges: DataFrame, address_col: str = "remote_ip") -> DataFrame:
    """``rows`` with country, subdivision1_code and city of the narrowest range that holds the address, null where there is
    none. ``ranges``: low, high (first and last address as text), country, subdivision1_code, city."""
    texts = rows.select(F.col(address_col).alias("_text")).filter("_text is not null").distinct()
    texts = work.written(texts.withColumn("at", bits(F.col("_text"))).filter("at is not null"), "addresses")
    found = located(texts.select("at").distinct(), pieces(ranges))
    known = texts.join(found, "at").select("_text", "place")
    met = rows.join(known, F.col(address_col) == F.col("_text"), "left")
    return met.select(*rows.columns, *[f"place.{c}" for c in PLACE])
