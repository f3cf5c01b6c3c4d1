"""States of records from a stream of their events, with a timer for those that got stuck.

Each key holds its last event and since when; a record that has been in flight for too long without
another event is put back to ``REQUEUED``, once per stay. Time is the events' own, so a record whose
next event comes too late was requeued before it, whether a timer fired in between or both events came
in one batch: the states don't depend on how the stream is cut into batches, and a restart goes on from
its checkpoint. Events of one key are taken in order of their number, batch by batch: an event with a
lower number than one taken before is ignored. A batch holds what the stream's own limits let in.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

REQUEUED = "pending"
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: One row for each change: the key, the number of its last event, its state, and how often it was requeued so far.
OUTPUT = "key long, number long, state string, requeued long"


class RecordStates(StatefulProcessor):
    def __init__(self, in_flight: tuple[str, ...], stale_after_ms: int):
        self.in_flight, self.stale_after_ms = in_flight, stale_after_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "number long, state string, due long, requeued long")

    def _row(self, key: tuple, number: int, state: str, requeued: int) -> pd.DataFrame:
        return pd.DataFrame({"key": [key[0]], "number": [number], "state": [state], "requeued": [requeued]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        number, state, due, requeued = self.held.get() if self.held.exists() else (-1, None, None, 0)
        before = due
        events = pd.concat(list(rows)).sort_values("number", kind="stable")
        for n, at, kind in zip(events["number"].tolist(), events["at_ms"].tolist(), events["state"].tolist(), strict=True):
            if n <= number:
                continue
            if due is not None and at > due:
                requeued += 1
            number, state, due = n, kind, at + self.stale_after_ms if kind in self.in_flight else None
        if before != due:
            if before is not None:
                self.handle.deleteTimer(before)
            if due is not None:
                self.handle.registerTimer(due)
        self.held.update((number, state, due, requeued))
        yield self._row(key, number, state, requeued)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        number, state, due, requeued = self.held.get()
        if due is not None and due <= expiredTimerInfo.getExpiryTimeInMs():
            self.held.update((number, REQUEUED, None, requeued + 1))
            yield self._row(key, number, REQUEUED, requeued + 1)

    def close(self) -> None:
        pass


def states(events: DataFrame, in_flight: tuple[str, ...], stale_after_ms: int) -> DataFrame:
    """Changes, as ``OUTPUT``, of a stream of ``key, number, at, state``; ``at`` ascends with ``number``."""
    at = F.col("at").cast("timestamp")
    timed = events.select(F.col("key").cast("long").alias("key"), F.col("number").cast("long").alias("number"), at.alias("at"), F.unix_millis(at).alias("at_ms"), "state").withWatermark("at", "0 seconds")
    return timed.groupBy("key").transformWithStateInPandas(RecordStates(in_flight, stale_after_ms), OUTPUT, "Update", "EventTime")


def run(spark: SparkSession, changes: DataFrame, path: str, checkpoint: str) -> None:
    """Take in what is there now, and append the changes to a table at ``path``; a batch that runs again replaces its own rows."""
    name, provider = PROVIDER
    before = spark.conf.get(name)
    spark.conf.set(name, provider)
    try:
        write = lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/batch={n}")
        changes.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(name, before)


def latest(spark: SparkSession, path: str) -> DataFrame:
    """``key, number, state, requeued`` as they are now."""
    rows = spark.read.schema(f"{OUTPUT}, batch long").parquet(path)
    last = rows.groupBy("key").agg(F.max_by(F.struct("number", "state", "requeued"), F.struct("number", "requeued", "batch")).alias("x"))
    return last.select("key", "x.*")
