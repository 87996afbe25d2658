"""Scan progress as streams: events from lines, a fold into each scan's state, retries, and a cache that forgets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import event_lines


def events(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the event lines that arrive in a folder."""
    return event_lines(spark.readStream.text(folder))


def fold(df: DataFrame, keys: list[str] = ["scan_id"]) -> DataFrame:  # noqa: B006
    """(keys, stage, message, completed, total, failures, done): works on a stream in complete or update mode as on a table."""
    last = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct("seq", c)))[c].alias(c)
    failed = F.count_if(F.col("type") == "page-failed").alias("failures")
    return df.groupBy(*keys).agg(last("stage"), last("message"), last("completed"), last("total"), failed, F.bool_or(F.col("type").isin("done", "error")).alias("done"))


def recent(df: DataFrame, ttl: str = "1 hour") -> DataFrame:
    """Each scan once while it is within its time to live."""
    return df.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(["scan_id"])


def retry_merge(stored: DataFrame, fetched: DataFrame, failed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages and failures after a retry: new pages replace stored ones of their address, and failures are those of the retry."""
    keys = ["scan_id", "url"]
    return stored.join(fetched.select(*keys), keys, "left_anti").unionByName(fetched), failed.join(fetched.select(*keys), keys, "left_anti")


def each_batch(apply: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """A sink for foreachBatch that leaves empty batches out, so that one writer at a time touches the store."""

    def run(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            apply(batch)

    return run
