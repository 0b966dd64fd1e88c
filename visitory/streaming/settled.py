"""Visits of a stream in order of event time, whole and final: what the batch gives, on every column.

A hit waits in the typed state of its visitor until its visit is settled: a visit begins at the first waiting hit and
holds all hits of the next 15 minutes, and once the watermark has passed its end no other hit can join it. An event-time
timer stands at the end of the first waiting visit; when it fires, settled visits leave the state whole, and the timer
moves to the next one. So hits may come in any order within the allowed lateness, and a visitor without waiting hits has
no state. A hit that comes again (same site, visitor, time and number) within that time still finds the first one
waiting, as its visit ends later than the watermark, and is dropped when the visit is settled; one that comes later than that is dropped as well, as the
watermark says, and belongs to :func:`visitory.sources.upkeep.add`.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from operator import itemgetter

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import BooleanType, ByteType, IntegerType, LongType, ShortType, StringType, StructType

from ..operators.visits import WINDOW_US

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Of a hit in its visit: the visit's start, 0, 1 or 2 for the first, second or a later one, the time of the hit before, the
#: page of the visit's first hit and of its last view.
PLACE = "visit_start bigint, n int, before bigint, first string, last string"
#: Types that a JSON text keeps as they are.
PACKED = (StringType, BooleanType, ByteType, ShortType, IntegerType, LongType)
PIECE = 1000


def prepare(spark: SparkSession) -> None:
    """Sets the state store that timers and list state need; call it before a query starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class Settled(StatefulProcessor):
    """Waiting hits of one visitor. What a batch brings of a visitor is one pickled element of the list, in pieces of
    :data:`PIECE` hits, so a hit costs no call of its own; ``names`` are the columns, ``_us`` and ``seq`` among them."""

    def __init__(self, names: list[str], window_us: int) -> None:
        self.names, self.window_us = names, window_us
        self.made = Row(*(c for c in names if c != "seq"), "visit_start", "n", "before", "first", "last")

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "hits binary")
        self.due = handle.getValueState("due", "ms bigint")

    def _end(self, start_us: int) -> int:
        """The first millisecond at or after the end of a visit."""
        return -(-(start_us + self.window_us) // 1000)

    def _pieces(self, hits: list[tuple]) -> list[tuple[bytes]]:
        return [(pickle.dumps(hits[k : k + PIECE], protocol=5),) for k in range(0, len(hits), PIECE)]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new, pick, first = [], None, None
        for r in rows:
            pick = pick or itemgetter(*map(r.__fields__.index, self.names))
            new.append(pick(tuple(r)))
        for piece in self._pieces(new):
            self.waiting.appendValue(piece)
        us = self.names.index("_us")
        first, due = self._end(min(h[us] for h in new)), self.due.get()
        if due is None or first < due[0]:
            # the timer stands at the end of the first waiting visit
            if due is not None:
                self.handle.deleteTimer(due[0])
            self.handle.registerTimer(first)
            self.due.update((first,))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        us, seq = self.names.index("_us"), self.names.index("seq")
        hits = [h for (piece,) in self.waiting.get() for h in pickle.loads(piece)]
        # the sort keeps the order of arrival among equal ones, and of these the first stays
        hits.sort(key=lambda h: (h[us], h[seq] is not None, h[seq]))
        hits = [h for k, h in enumerate(hits) if not k or (h[us], h[seq]) != (hits[k - 1][us], hits[k - 1][seq])]
        settled_ms, k, out = timerValues.getCurrentWatermarkInMs(), 0, []
        while k < len(hits) and self._end(hits[k][us]) <= settled_ms:
            end = k
            while end < len(hits) and hits[end][us] < hits[k][us] + self.window_us:
                end += 1
            out += self._visit(hits[k:end])
            k = end
        if k < len(hits):
            self.waiting.put(self._pieces(hits[k:]))
            end = self._end(hits[k][us])
            self.handle.registerTimer(end)
            self.due.update((end,))
        else:
            self.waiting.clear()
            self.due.clear()
        return iter(out)

    def _visit(self, hits: list[tuple]) -> list[Row]:
        us, seq, seen = (self.names.index(c) for c in ("_us", "seq", "_seen"))
        start, before = hits[0][us], hits[0][us]
        first, last, out = hits[0][seen], next((h[seen] for h in reversed(hits) if h[seen] is not None), None), []
        for n, h in enumerate(hits):
            out.append(self.made(*h[:seq], *h[seq + 1 :], start, min(n, 2), before, first, last))
            before = h[us]
        return out

    def close(self) -> None:
        pass


def visits(hits: DataFrame, late: str = "10 minutes", window_us: int = WINDOW_US) -> DataFrame:
    """All columns of a stream's hits with visit_start, session, bounce, duration, entry_page, exit_page, true_exit_page
    and the host of views, as ``operators.visits.visits`` gives them. Columns besides ``ts`` are plain values. Hits
    without a site, visitor or time are left out.

    Texts, whole numbers and flags go through the state as one JSON text a hit, as every column of a row costs time
    there; columns of other types go as they are."""
    rows = hits.filter("domain is not null and id is not null and ts is not null").withColumn("_at", F.col("ts").cast("timestamp")).withWatermark("_at", late)
    packed = StructType([f for f in hits.schema.fields if f.name != "ts" and isinstance(f.dataType, PACKED)])
    plain = [f for f in hits.schema.fields if f.name != "ts" and not isinstance(f.dataType, PACKED)]
    cells = {"_us": F.unix_micros("_at"), "_seen": F.when(F.col("view"), F.col("page")), "_body": F.to_json(F.struct(*packed.names)), **{f"_plain{k}": F.col(f.name) for k, f in enumerate(plain)}}
    rows = rows.select("_at", "domain", "id", "seq", *[c.alias(n) for n, c in cells.items()])
    out = ", ".join(["_us bigint", "_seen string", "_body string", *[f"_plain{k} {f.dataType.simpleString()}" for k, f in enumerate(plain)]])
    made = rows.groupBy("domain", "id").transformWithState(Settled(["seq", *cells], window_us), f"{out}, {PLACE}", "append", "eventTime")
    made = made.withColumn("_hit", F.from_json("_body", packed))
    column = {f.name: F.col(f"_hit.{f.name}") for f in packed.fields} | {f.name: F.col(f"_plain{k}") for k, f in enumerate(plain)}
    column |= {"ts": F.timestamp_micros("_us").cast("timestamp_ntz"), "host": F.when(column["view"], column["host"])}
    n, first, seen = F.col("n"), F.col("first"), F.col("_seen")
    return made.select(
        *[column[c].alias(c) for c in hits.columns],
        "visit_start",
        (n == 0).alias("session"),
        F.when(n == 0, 1).when(n == 1, -1).otherwise(0).alias("bounce"),
        (F.col("_us") - F.col("before")).alias("duration"),
        F.coalesce(first, seen).alias("entry_page"),
        F.coalesce(seen, first).alias("exit_page"),
        F.col("last").alias("true_exit_page"),
    )
