"""Change feeds: the latest write of each file, batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomgraph.operators.graph import latest


def latest_states(feed: DataFrame) -> DataFrame:
    """(path, row, writes) of a feed (path, seq, ...): the write with the highest seq; for batch and streams in update mode."""
    return feed.groupBy("path").agg(F.max_by(F.struct(*feed.columns), "seq").alias("row"), F.count("*").alias("writes"))


def late_free(feed: DataFrame, delay: str = "1 hour") -> DataFrame:
    """A feed (path, ts, seq) without repeats of a write that come within the delay."""
    return feed.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["path", "seq"])


def apply_changes(feed: DataFrame, sync: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Calls sync with the last write of each path of every batch; a batch seen again has the same number."""

    def one(batch: DataFrame, number: int) -> None:
        sync(latest(batch, ["path"], F.col("seq")), number)

    return feed.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
