"""Sources and sinks: pages, stores, event lines, caches and exports."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .store import Store

EVENT = "type string, scan_id string, seq long, stage string, message string, completed int, total int, current_url string, url string, reason string, kind string, ts timestamp"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: pages that a task reads as trees
PAGES_A_TASK = 20_000


def tasks(spark: SparkSession, pages: int) -> int:
    """Into how many partitions pages are dealt before they are read: reading costs far more than their rows' bytes tell, by which files are split and shuffles joined up."""
    return max(2 * spark.sparkContext.defaultParallelism, -(-pages // PAGES_A_TASK))


def store(spark: SparkSession, path: str, schema: StructType | str, fmt: str = "parquet") -> DataFrame:
    """A stored table; an empty one where nothing is stored yet."""
    try:
        return spark.read.schema(schema).format(fmt).load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def swap(df: DataFrame, path: str) -> int:
    """Puts a table in the place of the old one; a job that is lost midway leaves the old one in force, and the next one goes on from it."""
    return Store(df.sparkSession, path, df.schema.toDDL()).replace(df)


def latest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table in force of those written by `swap`; an empty one where there is none."""
    return Store(spark, path, schema).read()


def event_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Events from lines of JSON; blank and broken lines go."""
    e = F.from_json(F.col(column), EVENT, {"mode": "PERMISSIVE"})
    return lines.filter(F.length(F.trim(column)) > 0).select(e.alias("e")).select("e.*").filter("type IS NOT NULL")


def to_lines(events: DataFrame) -> DataFrame:
    """One JSON object a line."""
    return events.select(F.to_json(F.struct("*")).alias("value"))


def prune_cache(scans: DataFrame, now: Column, ttl_minutes: int = 60) -> DataFrame:
    """Cached scans not older than the time to live; on read as well as on write."""
    return scans.filter(F.col("stored_at") >= now - F.expr(f"INTERVAL {ttl_minutes} MINUTES"))


def cached_scan(scans: DataFrame, scan_id: str, now: Column) -> DataFrame:
    clean = "".join(c for c in scan_id if c.isascii() and (c.isalnum() or c == "-"))
    return prune_cache(scans, now).filter(F.col("scan_id") == clean)


def export_name(name: Column) -> Column:
    """The file name of a profile's JSON export."""
    return F.concat(F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), F.lit("-")), F.lit(".json"))


def exports(documents: DataFrame, name: str, data: str) -> DataFrame:
    """(file, value): each document's JSON as it is saved, with the name of its file."""
    return documents.select(export_name(F.col(name)).alias("file"), F.to_json(F.col(data)).alias("value"))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir), or in a temporary one where that is unset (tests)."""
    place = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="pagequarry-")
    return f"{place}/{name}-{uuid.uuid4().hex}"


def phrases(spark: SparkSession, labelled: dict[str, list[str]]) -> DataFrame:
    """(label, phrase, ord) of a dictionary, in its order."""
    rows = [(k, p) for k, ps in labelled.items() for p in ps]
    return spark.createDataFrame([(k, p, i) for i, (k, p) in enumerate(rows)], "label string, phrase string, ord int")


def domains(spark: SparkSession, labelled: dict[str, list[str]]) -> DataFrame:
    return phrases(spark, labelled).withColumnRenamed("phrase", "domain")
