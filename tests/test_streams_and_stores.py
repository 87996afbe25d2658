"""Stores that swap, caches that forget, and the progress stream."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pagequarry.operators import extract, registry
from pagequarry.sources import captured, store, tables
from pagequarry.streaming import progress, scans

LINES = ['{"type":"stage","scan_id":"a","seq":1,"stage":"crawl","ts":"2024-01-01T00:00:00"}', "", "oops", '{"type":"page-progress","scan_id":"a","seq":2,"completed":1,"total":3,"ts":"2024-01-01T00:01:00"}', '{"type":"page-failed","scan_id":"a","seq":3,"ts":"2024-01-01T00:02:00"}', '{"type":"done","scan_id":"a","seq":4,"ts":"2024-01-01T00:03:00"}', '{"type":"stage","scan_id":"b","seq":1,"stage":"parse","ts":"2024-01-01T05:00:00"}']


def test_swap_keeps_the_old_version_until_the_new_one_is_there(spark, tmp_path):
    path, schema = str(tmp_path / "db"), "id long, name string"
    assert tables.latest(spark, path, schema).isEmpty()
    assert tables.swap(spark.createDataFrame([(1, "a")], schema), path) == 1
    assert tables.swap(spark.createDataFrame([(2, "b"), (3, None)], schema), path) == 2
    assert sorted(r.id for r in tables.latest(spark, path, schema).collect()) == [2, 3]
    bad = spark.createDataFrame([(4, "x")], schema).withColumn("name", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        tables.swap(bad, path)
    assert sorted(r.id for r in tables.latest(spark, path, schema).collect()) == [2, 3]
    assert tables.swap(spark.createDataFrame([(5, "c")], schema), path) == 3  # the failed write is in nobody's way
    assert [r.id for r in tables.latest(spark, path, schema).collect()] == [5]


def test_two_writers_and_cleaning(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "t"), "k string, n long", ["k"], 4)
    assert s.read().isEmpty() and s.current()[0] == 0
    s.replace(spark.createDataFrame([("a", 1), ("b", 1), (None, 1)], "k string, n long"))
    raced = []

    def add(old):
        if not raced:  # another writer commits between this one's reading and its commit
            raced.append(1)
            other = store.Store(spark, str(tmp_path / "t"), "k string, n long", ["k"], 4)
            other.transact(lambda rows: rows.withColumn("n", F.col("n") + 10))
        return old.withColumn("n", F.col("n") + 1)

    assert s.transact(add) == 3 and {r.k: r.n for r in s.read().collect()} == {"a": 12, "b": 12, None: 12}
    with pytest.raises(store.Conflict):
        s._commit(3, {"folders": {}, "note": None})
    only = spark.createDataFrame([("a",)], "k string").select(s.bucket()).first()[0]
    s.transact(lambda old: old.filter("k <> 'a'"), [only])
    assert "a" not in {r.k for r in s.read().collect()} and None in {r.k for r in s.read().collect()}
    with pytest.raises(ValueError, match="aren't being replaced"):
        s.transact(lambda _: spark.createDataFrame([(x, 0) for x in "abcdefgh"], "k string, n long"), [only])
    before = sorted(map(tuple, s.read().collect()), key=str)
    assert s.clean(keep=1) >= 2 and s.clean(keep=1) == 0
    assert sorted(map(tuple, s.read().collect()), key=str) == before


def test_scan_cache(spark, tmp_path):
    cache = store.ScanCache(spark, str(tmp_path / "c"))
    at = lambda h, m=0: F.lit(dt.datetime(2024, 1, 1, h, m))
    first, other = cache.put("one", at(10)), cache.put("two", at(10, 30))
    assert [r.payload for r in cache.get(first + "/../", at(10, 50)).collect()] == ["one"]
    cache.replace(first, "three", at(10, 40))
    assert [r.payload for r in cache.get(first, at(11, 20)).collect()] == ["three"]
    assert cache.get(other, at(11, 31)).isEmpty() and cache.store.read().count() == 2  # not read any more, but still there
    cache.prune(at(11, 31))
    assert [r.payload for r in cache.store.read().collect()] == ["three"]


def test_captured_pages(spark, tmp_path):
    import json

    spark.dataSource.register(captured.CapturedPages)
    rows = [{"url": "a", "status": 200, "content_type": "text/html; charset=utf-8", "body": "x" * 50}, {"url": "b", "status": 403}, {"url": "c", "status": 500, "body": "no"}, {"url": "d", "content_type": "image/png; x", "status": 200}, {"url": "e", "error": "ENOTFOUND"}, {"url": "f", "error": "odd"}, {"url": "g"}, {"url": "h", "status": 200, "content_type": "", "body": None}]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text("\n".join(json.dumps(r) for r in rows) + "\n\nbroken\n[1]\n")
    spark.createDataFrame([("p", 204), ("q", 429)], "url string, status int").coalesce(1).write.parquet(str(tmp_path / "in" / "more"))
    got = {r.url: r for r in spark.read.format("captured_pages").option("max_chars", "10").load(str(tmp_path / "in")).collect()}
    assert {u: r.reason for u, r in got.items()} == {"a": None, "b": "blocked", "c": "http-error", "d": "not-html", "e": "dns", "f": "unknown", "g": None, "h": None, "p": None, "q": "blocked"}
    assert got["a"].body == "x" * 10 and got["d"].message == "That address returned image/png, not a web page." and got["c"].body is None and got["g"].body == ""
    (tmp_path / "none").mkdir()
    assert spark.read.format("captured_pages").load(str(tmp_path / "none")).isEmpty()


def feed(folder, name, rows):
    import json

    (folder / f".{name}").write_text("\n".join(json.dumps(r) for r in rows))
    (folder / f".{name}").rename(folder / name)


def test_pages_nobody_fetched_fail_at_the_deadline(spark, tmp_path):
    import time

    folder = tmp_path / "in"
    folder.mkdir()
    e = lambda scan, kind, url=None: {"type": kind, "scan_id": scan, "url": url}
    feed(folder, "a.jsonl", [e("s", "page-planned", "u1"), e("s", "page-planned", "u2"), e("t", "page-planned", "v"), e("w", "page-planned", "x"), e("s", "page-progress", "u1"), e("w", "done")])
    stream = scans.deadlines(progress.events(spark, str(folder)), budget_ms=8000)
    q = stream.writeStream.outputMode("append").format("memory").queryName("late_pages").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second").start()
    try:
        until = time.time() + 60  # such a stream runs batches without data as well, so that it never has processed all
        while not any(p.numInputRows for p in q.recentProgress) and time.time() < until:
            time.sleep(0.2)
        feed(folder, "b.jsonl", [e("t", "page-failed", "v"), e("new", "page-progress", "z")])
        until = time.time() + 60
        while spark.table("late_pages").isEmpty() and time.time() < until:
            time.sleep(0.5)
    finally:
        q.stop()
    assert [tuple(r) for r in spark.table("late_pages").collect()] == [("s", "u2", "timeout", scans.OUT_OF_TIME)]


def test_a_late_page_changes_its_site_alone(spark, tmp_path):
    made = []

    def summarize(pages):
        made.append(sorted({r.site for r in pages.select("site").collect()}))
        return pages.groupBy("site").agg(F.count("*").alias("n"), F.max("html").alias("best"))

    sites = scans.Sites(spark, str(tmp_path / "s"), summarize, "site string, n long, best string", ttl="2 hours", buckets=4)
    folder = tmp_path / "in"
    folder.mkdir()
    page = lambda site, url, seq, html, hour, ok=True: {"site": site, "url": url, "seq": seq, "ok": ok, "reason": None if ok else "timeout", "html": html, "stored_at": f"2024-01-01T{hour:02}:00:00"}

    def run():
        q = spark.readStream.schema(scans.PAGES).json(str(folder)).writeStream.foreachBatch(sites.upsert).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
        return {r.site: (r.n, r.best) for r in sites.rows.read().collect()}

    feed(folder, "1.json", [page("a", "/", 1, "a1", 1), page("a", "/x", 2, None, 1, False), page("b", "/", 1, "b1", 1), page("c", "/", 1, "c1", 1)])
    assert run() == {"a": (1, "a1"), "b": (1, "b1"), "c": (1, "c1")}
    feed(folder, "2.json", [page("a", "/x", 3, "a2", 2), page("a", "/", 4, None, 2, False)])
    assert run() == {"a": (2, "a2"), "b": (1, "b1"), "c": (1, "c1")} and made[-1] == ["a"]
    assert {(r.url, r.ok) for r in sites.pages.read().filter("site = 'a'").collect()} == {("/", True), ("/x", True)}
    feed(folder, "3.json", [page("b", "/new", 1, "b2", 9)])  # b's first page is too old by now
    assert run() == {"a": (2, "a2"), "b": (1, "b2"), "c": (1, "c1")} and made[-1] == ["b"]
    again = spark.createDataFrame([("c", "/", 9, True, None, "c9", dt.datetime(2024, 1, 1, 9))], scans.PAGES)
    sites.upsert(again, 2)  # a batch that has been taken already
    assert {r.site: r.best for r in sites.rows.read().collect()}["c"] == "c1"


def test_cached_scan_forgets_and_cleans_its_id(spark):
    rows = spark.createDataFrame([("a-1", dt.datetime(2024, 1, 1, 10)), ("b", dt.datetime(2024, 1, 1, 8))], "scan_id string, stored_at timestamp")
    now = F.lit(dt.datetime(2024, 1, 1, 10, 30))
    assert tables.cached_scan(rows, "a-1/..", now).count() == 1 and tables.cached_scan(rows, "b", now).isEmpty()


def test_progress_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text("\n".join(LINES))
    q = progress.fold(progress.events(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("folded").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = {r.scan_id: r for r in spark.table("folded").collect()}
    assert (got["a"].stage, got["a"].completed, got["a"].total, got["a"].failures, got["a"].done) == ("crawl", 1, 3, 1, True) and not got["b"].done


def test_recent_scans_and_serial_writes(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text("\n".join(LINES))
    seen = []
    q = progress.recent(progress.events(spark, str(tmp_path / "in"))).writeStream.foreachBatch(progress.each_batch(lambda b: seen.extend(r.scan_id for r in b.collect()))).option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(seen) == ["a", "b"]


def test_sitemap_index_flag_and_trimmed_lists(spark):
    docs = spark.createDataFrame([(1, "<SitemapIndex><loc>a.xml</loc></SitemapIndex>"), (2, "<urlset><loc>b</loc></urlset>"), (3, None)], "id long, xml string")
    assert sorted((r.id, r.is_index) for r in extract.sitemap_urls(docs).collect()) == [(1, True), (2, False)]
    got = registry.prune(spark.createDataFrame([(["1 a ", " ", "b 1"],)], "tags array<string>"), [registry.Field("tags", "people", 3, "stringList")]).first()
    assert got.tags == ["1 a", "b 1"]
