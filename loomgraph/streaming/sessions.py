"""State of sessions over a change feed: latest write of each path, an iteration counter, and expiry of idle sessions."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

#: The state store that keeps maps and timers.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
OUT = "session_id long, path string, seq long, writes long, iteration long, closed boolean"
Told = Row("session_id", "path", "seq", "writes", "iteration", "closed")


class Sessions(StatefulProcessor):
    """Keeps a session's paths in a map, so a row touches its own path only, however many a session has.

    All that is kept is a maximum or a count, so rows may come in any order. A session that is idle until
    the watermark passes its last row by `idle` milliseconds tells each path once more as closed and is forgotten.
    """

    def __init__(self, idle: int) -> None:
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.paths = handle.getMapState("paths", "path string", "seq long, writes long")
        self.session = handle.getValueState("session", "iteration long, last long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        iteration, last = self.session.get() if self.session.exists() else (0, None)
        before, changed = last, set()
        for r in rows:
            if r["ms"] is not None:
                last = r["ms"] if last is None else max(last, r["ms"])
            if r["path"] is None:
                iteration += 1
                continue
            at = (r["path"],)
            seq, writes = self.paths.getValue(at) if self.paths.containsKey(at) else (None, 0)
            self.paths.updateValue(at, (r["seq"] if seq is None or (r["seq"] or 0) > seq else seq, writes + 1))
            changed.add(r["path"])
        self.session.update((iteration, last))
        if last != before:
            if before is not None:
                self.handle.deleteTimer(before + self.idle)
            self.handle.registerTimer(last + self.idle)
        for path in sorted(changed):
            yield Told(key[0], path, *self.paths.getValue((path,)), iteration, False)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        iteration = self.session.get()[0]
        for (path,), (seq, writes) in self.paths.iterator():
            yield Told(key[0], path, seq, writes, iteration, True)
        self.paths.clear()
        self.session.clear()

    def close(self) -> None:
        pass


def sessions(feed: DataFrame, idle: timedelta = timedelta(days=1), delay: str = "1 hour") -> DataFrame:
    """(session_id, path, seq, writes, iteration, closed) of a stream (session_id, path, seq, ts): a row for each path that a batch changes, and for each of a closed session.

    A row without a path ends an iteration. Rows without a session are ignored; rows later than the watermark as well.
    """
    rows = feed.where("session_id is not null").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    rows = rows.select(F.col("session_id").cast("long"), "path", F.col("seq").cast("long"), "ts", F.unix_millis("ts").alias("ms"))
    return rows.groupBy("session_id").transformWithState(Sessions(idle // timedelta(milliseconds=1)), OUT, "Update", "EventTime")


def keep(feed: DataFrame, folder: str, checkpoint: str, idle: timedelta = timedelta(days=1), delay: str = "1 hour") -> StreamingQuery:
    """Writes what sessions tells to the folder, a table for each batch; a batch that is run again replaces its own."""
    spark = feed.sparkSession

    def one(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    old = spark.conf.get(STORE[0], None)
    spark.conf.set(*STORE)
    try:
        return sessions(feed, idle, delay).writeStream.outputMode("update").foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        if old is None:
            spark.conf.unset(STORE[0])
        else:
            spark.conf.set(STORE[0], old)


def told(spark: SparkSession, folder: str) -> DataFrame:
    """The last row of each path from a folder of keep. A session that goes on after it was closed is told by its newer part."""
    rows = spark.read.schema(OUT + ", batch long").parquet(folder)
    last = rows.groupBy("session_id", "path").agg(F.max_by(F.struct("seq", "writes", "closed"), "batch").alias("r"), F.max("batch").alias("b"))
    counter = rows.groupBy("session_id").agg(F.max_by("iteration", F.struct("batch", "iteration")).alias("iteration"))
    return last.join(counter, "session_id").select("session_id", "path", "r.seq", "r.writes", "iteration", "r.closed")
