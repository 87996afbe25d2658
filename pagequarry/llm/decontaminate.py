"""Benchmark decontamination with a positional inverted index, as DataFrame operations.

Test items are phrases.  A window is ten consecutive words of an item (the
whole item where it is shorter).  Every window is looked up by its rarest
term, as counted over all training documents: only these terms' postings
(term, document, position) are made, each list is shifted by the term's offset
in the window, and the window's other terms must stand at their offsets, which
the posting's neighbouring words tell.

The postings are stored as a table in the order of their terms; each has the
words around it, so that one lookup gives both exact phrases and proximity
matches: windows all of whose words stand around the rarest one in any order.

The lists of common terms are never built, so a word that fills a third of the
corpus costs nothing unless a window has no other word.  The windows' terms
are broadcast while there are at most `BROADCAST_TERMS` of them, which is
counted; beyond that they are joined by a shuffle on the term.

Nulls and edges: very long texts are read whole, as postings.  Null or empty
texts have no words; items without words have no
windows; a null item_id counts as the empty text.  Rows are told apart by a key
of doc_id and text (`common.row_key`), so rows that share a doc_id or have none
are judged each by its own text; equal rows get equal results.  Equal items all
count.  Empty tables on either side are allowed.  Columns besides
doc_id/item_id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, row_key, scratch

WINDOW = 10
BROADCAST_TERMS = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: what stands between words: ASCII but digits and letters
GAP = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


def lower_ascii(x: Column) -> Column:
    """A-Z in lower case and nothing else; most words need no more than a comparison."""
    return F.when(F.lower(x) == x, x).otherwise(F.translate(x, UPPER, LOWER))


def words_of(text: Column) -> Column:
    """The words as they stand, not yet in lower case."""
    return F.filter(F.split(F.coalesce(text.cast("string"), F.lit("")), GAP), lambda x: x != "")


def item_windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item, win): every window of every item as an array of lower-case words; item is the identifier's text."""
    w = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.transform(words_of(F.col("text")), lower_ascii).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    return w.select("item", F.explode(starts).alias("s"), "w").select("item", F.slice("w", F.col("s"), F.lit(size)).alias("win")).distinct()


def _small(terms: DataFrame) -> bool:
    return terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n): how often each of the terms stands in the documents, 0 included."""
    side = F.broadcast(terms) if _small(terms) else terms
    seen = docs.select(F.explode(words_of(F.col("text"))).alias("x")).select(lower_ascii(F.col("x")).alias("term")).join(side, "term").groupBy("term").agg(F.count("*").alias("n"))
    return terms.join(seen, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"))


def anchors(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """Each window with its rarest term and that term's offset: (item, win, term, off)."""
    at = windows.select("item", "win", F.posexplode("win").alias("off", "term")).join(counts, "term")
    return at.groupBy("item", "win").agg(F.min(F.struct("n", "term", "off")).alias("m")).select("item", "win", F.col("m.term").alias("term"), F.col("m.off").alias("off"))


def postings(docs: DataFrame, terms: DataFrame, reach: int) -> DataFrame:
    """The positional index of the terms: (term, id, doc_id, pos, first, near); id is the row's key, near has the words from position first to pos + reach."""
    words = docs.select(row_key().alias("id"), F.col("doc_id").cast("long").alias("doc_id"), words_of(F.col("text")).alias("w"))
    first = F.greatest(F.col("pos") - reach, F.lit(0))

    def near(df: DataFrame) -> DataFrame:
        cut_out = F.transform(F.slice("w", first + 1, F.col("pos") - first + 1 + reach), lower_ascii)
        return df.select("term", "id", "doc_id", "pos", first.alias("first"), cut_out.alias("near"))

    if _small(terms):
        return near(words.select("id", "doc_id", "w", F.posexplode("w").alias("pos", "x")).select("id", "doc_id", "w", "pos", lower_ascii(F.col("x")).alias("term")).join(F.broadcast(terms), "term"))
    found = words.select("id", F.posexplode("w").alias("pos", "x")).select("id", "pos", lower_ascii(F.col("x")).alias("term")).join(terms, "term")
    return near(found.join(words.dropDuplicates(["id"]), "id"))


def store(index: DataFrame) -> DataFrame:
    """The postings written to the shared folder as a table in the order of their terms, and read from it."""
    path = scratch(index.sparkSession, "postings")
    index.repartition("term").sortWithinPartitions("term", "id", "pos").write.parquet(path)
    return index.sparkSession.read.parquet(path)


def look_up(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(id, start, length, item, phrase): windows of items around each posting of their rarest term.

    phrase tells that the window stands there word by word, at start; otherwise all its words stand within size - 1 words
    to either side, in any order.
    """
    windows = cut(item_windows(items, size))
    found = cut(anchors(windows, term_counts(docs, windows.select(F.explode("win").alias("term")).distinct())))
    index = store(postings(docs, found.select("term").distinct(), size - 1))
    start = F.col("pos") - F.col("off")
    side = F.broadcast(found) if _small(found) else found
    phrase = (start >= 0) & (F.slice("near", F.greatest(start - F.col("first") + 1, F.lit(1)), F.size("win")) == F.col("win"))
    hit = index.join(side, "term").select("id", start.alias("start"), F.size("win").alias("length"), "item", phrase.alias("phrase"), "win", "near")
    return hit.filter(F.col("phrase") | (F.size(F.array_except("win", "near")) == 0)).drop("win", "near")


def phrase_matches(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(id, start, length, item): every place where a window of an item stands in a document."""
    return look_up(docs, items, size).filter("phrase").drop("phrase")


def proximity_matches(docs: DataFrame, phrases: DataFrame, slop: int) -> DataFrame:
    """(doc_id, id, pos, item): places of each phrase's rarest term from which all its terms stand within slop words to either side, in any order."""
    whole = phrases.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.transform(words_of(F.col("text")), lower_ascii).alias("win")).filter(F.size("win") > 0).distinct()
    whole = cut(whole)
    found = cut(anchors(whole, term_counts(docs, whole.select(F.explode("win").alias("term")).distinct())))
    index = postings(docs, found.select("term").distinct(), slop)
    return index.join(found, "term").filter(F.size(F.array_except("win", "near")) == 0).select("doc_id", "id", "pos", "item").distinct()


def judge(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """One row for each document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near; n_near counts the items of which a window's words stand close together in any order, phrases included."""
    return judged(docs, items, size).drop("key")


def judged(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """`judge` with each row's key."""
    found = look_up(docs, items, size).groupBy("id", "start").agg(F.max(F.when(F.col("phrase"), F.col("length"))).alias("length"), F.collect_set(F.when(F.col("phrase"), F.col("item"))).alias("items"), F.collect_set("item").alias("near"))
    # a document's starts and items are gathered, which its own length and the items bound
    spans = F.collect_list(F.when(F.col("length").isNotNull(), F.struct("start", "length")))
    covered = F.array_distinct(F.flatten(F.transform(spans, lambda x: F.sequence(x["start"], x["start"] + x["length"] - 1))))
    flat = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    per = found.groupBy("id").agg(F.size(covered).cast("long").alias("n_hit"), flat("items").alias("items"), F.size(flat("near")).cast("long").alias("n_near"))
    per = per.select("id", "n_hit", "n_near", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("id"), F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    return rows.join(per, "id", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("id").alias("key"),
    )
