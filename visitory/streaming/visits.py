"""Visits over a stream of hits, with the state of each visitor's open visit, and the sink of finished hits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.visits import WINDOW_US
from ..sources import store

RESULT = "domain string, id long, seq long, ts timestamp_ntz, view boolean, event string, page string, host string, visit_start long, session boolean, bounce int, duration long, entry_page string, exit_page string"
STATE = "start long, last long, n long, page string"
#: A visitor's state goes when it has been idle for two windows.
IDLE_MS = 2 * WINDOW_US // 1000


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Hits of one visitor, those of a micro-batch in order of time; holds no more than that batch's hits of one visitor."""
    if state.hasTimedOut:
        state.remove()
        return
    rows = pd.concat(list(batches)).sort_values(["ts", "seq"], kind="stable")
    start, last, n, first = state.get if state.exists else (None, None, 0, None)
    out = []
    for domain, visitor, seq, ts, view, event, page, host in zip(*(rows[c] for c in ("domain", "id", "seq", "ts", "view", "event", "page", "host")), strict=True):
        at = int(ts.value // 1000)
        page_seen = page if view else None
        if start is None or at - start >= WINDOW_US:
            start, last, n, first = at, at, 0, page_seen
        n += 1
        entry = first if first is not None else page_seen
        leave = page_seen if view else first
        out.append((domain, visitor, seq, ts, view, event, page, host if view else None, start, n == 1, 1 if n == 1 else -1 if n == 2 else 0, max(0, at - last), entry, leave))
        last = max(last, at)
    state.update((start, last, n, first))
    state.setTimeoutDuration(IDLE_MS)
    yield pd.DataFrame(out, columns=[c.split()[0] for c in RESULT.split(", ")])


def visits(hits: DataFrame) -> DataFrame:
    """A stream of hits (domain, id, seq, ts, view, event, page, host) with visit_start, session, bounce, duration,
    entry_page and exit_page. Arrival order is processing order; within a micro-batch hits are sorted by time."""
    columns = hits.select("domain", "id", "seq", "ts", "view", "event", "page", "host")
    return columns.groupBy("domain", "id").applyInPandasWithState(_fold, RESULT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def sink(stream: DataFrame, path: str, checkpoint: str, every: str | None = "1 second"):
    """Starts adding a stream to the hit store. Each batch has a folder named by its number, which a batch that is run
    again after a failure replaces, so nothing is stored twice. Without ``every`` it ends once all that is there has been stored."""

    def put(rows: DataFrame, batch: int) -> None:
        store.write(rows, f"{path}/batch={batch}", "overwrite")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**({"processingTime": every} if every else {"availableNow": True})).start()


def counts(hits: DataFrame, interval: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Views and approximate visitors of each site and window, for hits at most ``late`` behind."""
    timed = hits.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy("domain", F.window("at", interval)).agg(F.count_if("view").alias("pageviews"), F.approx_count_distinct("id").alias("visitors"))
