"""Scans as they happen: deadlines that turn pages nobody fetched into failures, and late pages folded into stored sites."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.order import keep_first
from ..sources.store import Store

# The budget of a scan, and what is said of pages that it didn't reach.
BUDGET_MS = 45_000
OUT_OF_TIME = "The scan ran out of time before this page was fetched."
FAILURE = "scan_id string, url string, reason string, message string"


def deadlines(events: DataFrame, budget_ms: int = BUDGET_MS) -> DataFrame:
    """Failures of planned pages that weren't fetched within a scan's budget: a stream of (scan_id, url, reason, message).

    events are a stream of (scan_id, type, url): page-planned opens a page,
    page-progress and page-failed close it, done and error close the scan.  The
    budget runs, by the clock, from the first planned page on; what a scan keeps
    are its open pages, of which a scan plans few (`discover.budget`).  Events
    after the deadline change nothing.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            _, open_pages = state.get
            state.remove()
            yield pd.DataFrame([(key[0], url, "timeout", OUT_OF_TIME) for url in open_pages], columns=["scan_id", "url", "reason", "message"])
            return
        now = state.getCurrentProcessingTimeMs()
        began, known = state.get if state.exists else (now, [])
        events_ = pd.concat(list(batches))
        planned = dict.fromkeys([*known, *events_.loc[events_["type"] == "page-planned", "url"]])
        closed = set(events_.loc[events_["type"].isin(["page-progress", "page-failed"]), "url"])
        left = [] if events_["type"].isin(["done", "error"]).any() else [u for u in planned if u not in closed]
        if left:
            state.update((began, left))
            state.setTimeoutDuration(max(1, began + budget_ms - now))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(columns=["scan_id", "url", "reason", "message"])

    rows = events.select("scan_id", "type", "url").filter("scan_id IS NOT NULL AND type IS NOT NULL")
    return rows.groupBy("scan_id").applyInPandasWithState(run, FAILURE, "began long, pages array<string>", "append", GroupStateTimeout.ProcessingTimeTimeout)


PAGES = "site string, url string, seq long, ok boolean, reason string, html string, stored_at timestamp"


class Sites:
    """Pages by site and address, and a row for each site made from them; a batch changes the sites that it has pages of, and no other.

    `summarize` makes (site, …, of `schema`) of pages.  Of a page's captures the
    last successful one stays; a failure stays only while there is none.  Captures
    older than `ttl` before a batch's newest one go when their site is touched.
    A batch that comes again (its number is noted) changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str, summarize: Callable[[DataFrame], DataFrame], schema: str, ttl: str = "1 hour", buckets: int = 32):
        self.pages = Store(spark, f"{path}/pages", PAGES, ["site"], buckets)
        self.rows = Store(spark, f"{path}/sites", schema, ["site"], buckets)
        self.summarize, self.ttl, self.columns = summarize, ttl, [f.split()[0] for f in schema.split(", ")]

    def upsert(self, batch: DataFrame, number: int) -> None:
        """Takes a batch of captures (the columns of PAGES); for foreachBatch."""
        batch = batch.filter("site IS NOT NULL").select([f.split()[0] for f in PAGES.split(", ")]).persist()
        try:
            touched = sorted(r[0] for r in batch.select(self.pages.bucket()).distinct().collect())  # at most all buckets
            if not touched:
                return
            newest = batch.agg(F.max("stored_at")).first()[0]
            mine = batch.select("site").distinct()

            def merged(old: DataFrame) -> DataFrame:
                both = keep_first(old.unionByName(batch), ["site", "url"], [F.desc("ok"), F.desc("seq"), F.desc("stored_at")])
                fresh = F.col("stored_at") >= F.lit(newest) - F.expr(f"INTERVAL {self.ttl}")
                return both.join(mine.withColumn("__mine", F.lit(True)), "site", "left").filter(F.col("__mine").isNull() | fresh).drop("__mine")

            def summed(old: DataFrame) -> DataFrame:
                now = self.summarize(self.pages.read(touched).join(mine, "site", "left_semi").filter("ok"))
                return old.join(mine, "site", "left_anti").unionByName(now.select(self.columns))

            if (self.pages.current()[1]["note"] if self.pages.current()[1]["note"] is not None else -1) < number:
                self.pages.transact(merged, touched, number)
            if (self.rows.current()[1]["note"] if self.rows.current()[1]["note"] is not None else -1) < number:
                self.rows.transact(summed, touched, number)
        finally:
            batch.unpersist()
