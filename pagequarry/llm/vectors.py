"""Vectors as integers, for the operators over embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A component c becomes floor(SCALE * c).
SCALE = 256.0


def usable(vector: str = "embedding") -> Column:
    """Whether the vector is there and all of its components are finite numbers."""
    return F.col(vector).isNotNull() & ~F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))


def scaled(vector: str = "embedding") -> Column:
    """The components as longs; beyond a long's range they are its bounds."""
    return F.transform(vector, lambda c: F.floor(F.lit(SCALE) * c.cast("double")))


def common_length(rows: DataFrame, vector: str) -> int:
    """The length that most vectors have, of equally common ones the greater; 0 if there is none."""
    most = rows.groupBy(F.size(vector).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return most.d if most else 0
