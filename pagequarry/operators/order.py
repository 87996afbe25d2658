"""Operators for which order is data: every one takes explicit order columns that make a total order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Cols = Sequence[str | Column]


def keep_first(df: DataFrame, keys: Cols, order: Cols) -> DataFrame:
    """The first row of each key; null keys are one key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def top(df: DataFrame, keys: Cols, order: Cols, k: int, rank: str | None = None) -> DataFrame:
    """The first k rows of each key, with their rank if it is named."""
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= k)
    return out.withColumn(rank, F.col("__rn").cast("long")).drop("__rn") if rank else out.drop("__rn")


def round_robin(df: DataFrame, keys: Cols, source: str, order: Cols, k: int) -> DataFrame:
    """The first k rows of each key, taken in turns from its sources in the order in which they first appear."""
    # no source can give more than k rows: what is beyond goes before anything is ranked across sources
    turns = top(df, [*keys, source], order, k, "__turn")
    turns = turns.withColumn("__seat", F.min(F.struct(*order)).over(Window.partitionBy(*keys, source)))
    return top(turns, keys, ["__turn", "__seat"], k, "place").drop("__turn", "__seat")


def interleave(df: DataFrame, keys: Cols, tier: str, order: Cols, k: int, dedupe: Cols) -> DataFrame:
    """Like round_robin over tiers, but repeats go after the cut: fewer than k rows may be left."""
    turns = top(df, [*keys, tier], order, k, "__turn")
    return keep_first(top(turns, keys, ["__turn", tier], k, "place").drop("__turn"), [*keys, *dedupe], ["place"])


def by_frequency(df: DataFrame, keys: Cols, value: str, order: Cols, k: int | None = None) -> DataFrame:
    """Values by how often they occur, the earliest first among equals: (keys, value, n, place)."""
    counted = df.groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("__first"))
    return top(counted, keys, [F.desc("n"), "__first"], k or (1 << 30), "place").drop("__first")


def bundle(df: DataFrame, keys: Cols, text: str, order: Cols, k: int) -> DataFrame:
    """Up to k snippets of each key: blank ones go, and those that agree with an earlier one in their first 160 characters in any case."""
    shown = df.filter(F.length(F.trim(text)) > 0).withColumn("__head", F.lower(F.substring(text, 1, 160)))
    return top(keep_first(shown, [*keys, "__head"], order).drop("__head"), keys, order, k, "place")


def walk(df: DataFrame, parent: Cols, at: str, is_heading: Column, span: int) -> DataFrame:
    """Each heading with the siblings that follow it, at most span of them and none past the next heading: adds heading_at."""
    w = Window.partitionBy(*parent).orderBy(at)
    marked = df.withColumn("heading_at", F.last(F.when(is_heading, F.col(at)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    return marked.filter(~is_heading & F.col("heading_at").isNotNull() & (F.col(at) - F.col("heading_at") <= span))
