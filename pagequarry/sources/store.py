"""Tables that are replaced as a whole or by buckets, by numbered commits.

A store is a folder: data/ has a folder for each write, commits/ a small file for
each commit, which names the folder in force of every bucket.  A write first goes
to a folder of its own and counts only when its commit file is there.  Commit
files are numbered and created only if they don't exist, so of two writers that
began from the same commit one fails and starts again from the other's.  A job
that is lost midway leaves a folder that nothing names, which `clean` removes.

The file system has to create a file only where there is none (HDFS and local
ones do).  All access goes through Spark's file systems.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKET = "__bucket"


class Conflict(RuntimeError):
    """Another writer has committed first."""


class Store:
    """A table below a path, in `buckets` parts by the hash of its keys."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: Iterable[str] = (), buckets: int = 1):
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path.rstrip("/"), schema, list(keys), buckets
        self._at = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(path).getFileSystem(spark._jsc.hadoopConfiguration())

    # ---- commits

    def _commit_path(self, number: int):
        return self._at(f"{self.path}/commits/{number:012d}.json")

    def _numbers(self) -> list[int]:
        folder = self._at(f"{self.path}/commits")
        if not self._fs.exists(folder):
            return []
        return sorted(int(n[:12]) for s in self._fs.listStatus(folder) if (n := s.getPath().getName()).endswith(".json") and n[:12].isdigit())

    def _read(self, number: int) -> dict | None:
        source = self._fs.open(self._commit_path(number))
        try:
            text = bytes(source.readAllBytes()).decode()
        finally:
            source.close()
        return json.loads(text) if text.endswith("\n") else None  # one that is still being written isn't there yet

    def current(self) -> tuple[int, dict]:
        """The number and the content of the last commit: folders by bucket, and the writer's note."""
        for number in reversed(self._numbers()):
            if (commit := self._read(number)) is not None:
                return number, commit
        return 0, {"folders": {}, "note": None}

    def _commit(self, number: int, commit: dict) -> None:
        try:
            sink = self._fs.create(self._commit_path(number), False)
        except Py4JJavaError as e:
            if "AlreadyExists" in e.java_exception.getClass().getName():
                raise Conflict(f"commit {number} of {self.path} is another writer's") from e
            raise
        sink.write(bytearray((json.dumps(commit) + "\n").encode()))
        sink.close()

    # ---- rows

    def bucket(self) -> Column:
        """The bucket of a row."""
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int") if self.keys else F.lit(0)

    def read(self, only: Iterable[int] | None = None, at: tuple[int, dict] | None = None) -> DataFrame:
        """The rows in force, or those of some buckets; none where nothing is stored yet."""
        folders = (at or self.current())[1]["folders"]
        chosen = [f"{self.path}/{f}" for b, f in sorted(folders.items()) if only is None or int(b) in set(only)]
        if not chosen:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*chosen)

    def transact(self, change: Callable[[DataFrame], DataFrame], only: Iterable[int] | None = None, note: object = None, attempts: int = 5) -> int:
        """Puts what `change` makes of the rows (of some buckets) in their place; begins anew, up to `attempts` times, where another writer was first. Gives the commit's number."""
        only = sorted(set(range(self.buckets) if only is None else only))
        for attempt in range(attempts):
            number, commit = base = self.current()
            place = f"data/{uuid.uuid4().hex}"
            rows = change(self.read(only, base)).withColumn(BUCKET, self.bucket())
            rows.repartition(max(1, len(only)), BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/{place}")
            there = {s.getPath().getName() for s in self._fs.listStatus(self._at(f"{self.path}/{place}"))}
            folders = {b: f for b, f in commit["folders"].items() if int(b) not in only} | {str(b): f"{place}/{BUCKET}={b}" for b in only if f"{BUCKET}={b}" in there}
            stray = {n for n in there if n.startswith(BUCKET) and int(n.rpartition("=")[2]) not in only}
            if stray:
                raise ValueError(f"rows of buckets that aren't being replaced: {sorted(stray)}")
            try:
                self._commit(number + 1, {"folders": folders, "note": commit["note"] if note is None else note})
                return number + 1
            except Conflict:
                if attempt + 1 == attempts:
                    raise
        raise Conflict(self.path)

    def replace(self, rows: DataFrame) -> int:
        """Puts a table in the place of the old one."""
        return self.transact(lambda _: rows)

    def clean(self, keep: int = 3) -> int:
        """Removes all commits but the last `keep`, and the folders that none of these names; to be run while nobody writes. Gives the number of folders removed."""
        numbers = self._numbers()
        for n in numbers[:-keep]:
            self._fs.delete(self._commit_path(n), False)
        named = {f.split("/")[1] for n in numbers[-keep:] if (c := self._read(n)) for f in c["folders"].values()}
        data = self._at(f"{self.path}/data")
        loose = [s.getPath() for s in self._fs.listStatus(data) if s.getPath().getName() not in named] if self._fs.exists(data) else []
        for p in loose:
            self._fs.delete(p, True)
        return len(loose)


CACHE = "scan_id string, stored_at timestamp, payload string"


class ScanCache:
    """Scans for as long as they live; what is too old goes with the next write, and isn't read either."""

    def __init__(self, spark: SparkSession, path: str, ttl_minutes: int = 60):
        self.store, self.ttl = Store(spark, path, CACHE, ["scan_id"], 16), ttl_minutes

    def _clean_id(self, scan_id: str) -> str:
        return "".join(c for c in scan_id if c.isascii() and (c.isalnum() or c == "-"))

    def _bucket(self, scan_id: str) -> int:
        one = self.store.spark.range(1).select(F.lit(scan_id).alias("scan_id"))
        return one.select(self.store.bucket()).first()[0]

    def _fresh(self, rows: DataFrame, now: Column) -> DataFrame:
        return rows.filter(F.col("stored_at") >= now - F.expr(f"INTERVAL {self.ttl} MINUTES"))

    def replace(self, scan_id: str, payload: str, now: Column) -> str:
        """Stores a scan under its identifier, in the place of an earlier one."""
        own = self._clean_id(scan_id)
        row = self.store.spark.range(1).select(F.lit(own).alias("scan_id"), now.cast("timestamp").alias("stored_at"), F.lit(payload).alias("payload"))
        self.store.transact(lambda old: self._fresh(old, now).filter(F.col("scan_id") != own).unionByName(row), [self._bucket(own)])
        return own

    def put(self, payload: str, now: Column) -> str:
        """Stores a scan; gives its new identifier."""
        return self.replace(str(uuid.uuid4()), payload, now)

    def get(self, scan_id: str, now: Column) -> DataFrame:
        own = self._clean_id(scan_id)
        return self._fresh(self.store.read([self._bucket(own)]), now).filter(F.col("scan_id") == own)

    def prune(self, now: Column) -> int:
        return self.store.transact(lambda old: self._fresh(old, now))
