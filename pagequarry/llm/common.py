"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows without an identifier share this one; it sorts after every real one.
NO_ID = (1 << 63) - 1


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset (tests)."""
    sc = spark.sparkContext
    place = spark.conf.get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(place or tempfile.mkdtemp(prefix="pagequarry-"))
    return place or sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written once to the shared folder, so that what follows doesn't recompute them."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ident(column: str = "doc_id") -> Column:
    """The identifier as a long; null becomes NO_ID."""
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID))


def fold(column: str = "doc_id", folds: int = 3) -> Column:
    """crc32 of the identifier's text modulo folds; a null identifier has the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def row_key(column: str = "doc_id", text: str = "text") -> Column:
    """A 64-bit key of a row's identifier and text: rows that share an identifier, or have none, keep apart unless they are equal, and a task that runs again gives the same keys."""
    return F.xxhash64(F.col(column).cast("string"), F.lit("|"), F.col(text).cast("string"))


#: names beside the documents' own columns, so as not to clash with them
ID, TWIN = "__row_id", "__row_twin"


def told_apart(docs: DataFrame) -> DataFrame:
    """The rows with ID (`ident`) and TWIN, which is 0 for the only row of a doc_id, and the hash of the text for rows that share theirs or have none."""
    shared = cut(docs.select(F.col("doc_id").cast("long").alias(ID)).filter(F.col(ID).isNotNull()).groupBy(ID).agg(F.count("*").alias("n")).filter("n > 1").select(ID, F.lit(True).alias("__shared")))
    own, alone = F.xxhash64(F.col("text").cast("string")), F.col("doc_id").isNull()
    rows = docs.withColumn(ID, ident())
    if shared.isEmpty():
        return rows.withColumn(TWIN, F.when(alone, own).otherwise(F.lit(0)).cast("long"))
    return rows.join(shared, ID, "left").withColumn(TWIN, F.when(alone | F.col("__shared"), own).otherwise(F.lit(0)).cast("long")).drop("__shared")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The same rows as a table in the shared folder; unlike those of `cut`, their estimated size is that of the files, which matters where rounds build on each other."""
    path = scratch(df.sparkSession, "rows")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
