"""Repeated passages: De Bruijn compaction of 20-word windows.

The edges of the graph are windows of `WINDOW` consecutive words.  Windows that
follow each other and share their least `ANCHOR`-word hash (their anchor) make
a path; a path is compacted to one row (anchor, hash of all its words,
document, place).  What two documents have in common has the same paths but
for the ends, so equal paths meet by their hashes:

- every occurrence of a path but its first repeats all its windows;
- an anchor with a single path is a nonbranching node, so the first occurrence
  of that path has no repeats, unless the path holds its anchor twice;
- an anchor with several paths is a branching node.  Only the first occurrence
  of each of its paths (and of paths that hold their anchor twice) is opened
  into windows again, from the source text at its coordinates, and the windows
  meet by their own hashes.

A window's anchor depends on its own words alone, so equal windows have equal
anchors and no repeat is lost.  Every repeat carries the coordinates of an
earlier occurrence.  Repeats of one document that continue each other there are
compacted once more to maximal spans, and each span is verified: the words at
the source coordinates and its own must have the same digest, or it stays.

Scale: a path covers about six windows, and repeats within a batch are settled
before the shuffle (equal paths or windows of a batch send one row), so a
passage that stands in a third of all documents sends a row a batch.  Rows are
sorted by anchor and read as a stream; no group is gathered.

Nulls and edges: very long texts are read whole.  A null text has no words.  A null doc_id sorts last.  Rows
that share a doc_id, or have none, are told apart by their texts
(`common.told_apart`) and come in the order of the texts' hashes; equal rows
have equal coordinates, so they aren't each other's earlier copies and share
what is removed.  Texts shorter than a window keep all words.  An empty table
gives an empty table.  Columns besides doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkernel as tk
from .common import ID, TWIN, cut, told_apart

WINDOW, ANCHOR = 20, 10
#: rows of verified spans that are broadcast at most, which is counted
BROADCAST_SPANS = 100_000
#: a path or window and its place: `at` packs start, size, whether the anchor stands in it twice, and whether it is a repeat
#: within its batch, of which anchor and path are then the earlier occurrence's id and twin, and source its start
ROWS = "anchor long, path long, id long, twin long, at long, source long"
SPANS = "id long, twin long, start int, size int, anchor long, sid long, stwin long, sstart int"
MOST = (1 << 20) - 1


def paths_of(buf: np.ndarray, off: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """Paths of a batch: (anchor, path hash, document index, start in the document, windows, whether the anchor stands in it twice).

    Only a path with its anchor twice can hold a window twice.  One occurrence covers `window - anchor + 1` windows at most;
    in a path no longer than that, two occurrences stand in one of its windows together.
    """
    starts, ends, woff = tk.word_spans(buf, off)
    h = tk.word_hashes(buf, starts, ends)
    n = len(h)
    if n < window:
        z = np.zeros(0, np.int64)
        return z.view(np.uint64), z.view(np.uint64), z, z, z, z > 0
    a, _ = tk.windows(h, woff, anchor)
    width = window - anchor + 1
    low, have = a[: n - anchor + 1], 1  # the least of `have` anchors from each position on, doubled and then shifted
    while have * 2 <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < width:
        low = np.minimum(low[: len(low) - (width - have)], low[width - have :])
    count = n - window + 1
    low = low[:count]
    doc = tk.doc_of(woff)
    fits = doc[:count] == doc[window - 1 :]
    first = fits.copy()
    first[1:] &= ~fits[:-1] | (low[1:] != low[:-1]) | (doc[1:count] != doc[: count - 1])
    lo = np.flatnonzero(first)
    last = fits.copy()
    last[:-1] &= ~fits[1:] | first[1:]
    size = np.flatnonzero(last) - lo + 1
    d = doc[lo]
    times = np.zeros(count, np.int8)
    for j in range(width):
        times += a[j : j + count] == low
    sums = np.concatenate([[0], np.cumsum(times > 1)])
    twice = (sums[lo + size] > sums[lo]) | (size > width)
    if (size > MOST).any():  # an anchor over and over: parts that fit, which are opened in any case
        parts = -(-size // MOST)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        twice = np.repeat(twice | (parts > 1), parts)
        size = np.minimum(np.repeat(size, parts) - nth * MOST, MOST)
        lo, d = np.repeat(lo, parts) + nth * MOST, np.repeat(d, parts)
    return low[lo], tk.spans_hash(h, lo, lo + size + window - 1), d, lo - woff[d], size, twice


def _names(ddl: str) -> list[str]:
    return [x.split()[0] for x in ddl.split(", ")]


def _batch(anchor: np.ndarray, path: np.ndarray, id_: np.ndarray, twin: np.ndarray, start: np.ndarray, size: np.ndarray, twice: np.ndarray) -> pa.RecordBatch:
    """ROWS of a batch, all but the first occurrence of a path marked as repeats of it."""
    order = np.lexsort((start, twin, id_, path, anchor))
    a, p, k, t, s, z, w = (x[order] for x in (tk.signed(np.ascontiguousarray(anchor)), tk.signed(np.ascontiguousarray(path)), id_, twin, start.astype(np.int64), size.astype(np.int64), twice))
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (p[1:] != p[:-1])
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    done = (k != k[head]) | (t != t[head]) | (s != s[head])  # equal rows have the first one's coordinates
    at = s << 22 | z << 2 | w.astype(np.int64) << 1 | done
    cols = [np.where(done, k[head], a), np.where(done, t[head], p), k, t, at, np.where(done, s[head], 0)]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in cols], _names(ROWS))


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, twins = (b[c].to_numpy(zero_copy_only=False) for c in ("id", "twin"))
        for i, _, buf, off in tk.chunks(b["text"]):
            anchor, path, d, start, size, twice = paths_of(buf, off)
            if len(anchor):
                yield _batch(anchor, path, ids[i + d], twins[i + d], start, size, twice)


def _settle(last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """ROWS sorted by anchor, path, id, twin, at: repeats with their source (anchor null) and, unless last, first paths of branching anchors (anchor set)."""
        carry: list[np.ndarray] | None = None
        held: list[int] | None = None  # anchor, path and first coordinates of the last path sent on
        branching: int | None = None  # an anchor whose run goes on and is known to branch

        def spans(cols: list[np.ndarray], anchor: pa.Array) -> pa.RecordBatch:
            k, t, at, sk, st, ss = cols
            ints = [pa.array(x.astype(np.int32)) for x in (at >> 22, at >> 2 & MOST, ss)]
            return pa.RecordBatch.from_arrays([pa.array(k), pa.array(t), ints[0], ints[1], anchor, pa.array(sk), pa.array(st), ints[2]], _names(SPANS))

        def emit(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            nonlocal held
            a, p, k, t, at, _ = cols
            n, s = len(a), at >> 22
            same_a, same_p = np.zeros(n, bool), np.zeros(n, bool)
            same_a[1:] = a[1:] == a[:-1]
            same_p[1:] = same_a[1:] & (p[1:] == p[:-1])
            if held is not None:
                same_a[0] = a[0] == held[0]
                same_p[0] = same_a[0] and p[0] == held[1]
            group = np.cumsum(~same_a)
            head = np.flatnonzero(~same_p)
            at_head = np.searchsorted(head, np.arange(n), "right") - 1
            firsts = []
            for i, x in enumerate((k, t, s)):
                f = x[head[at_head]] if len(head) else x
                firsts.append(f if held is None else np.where(at_head < 0, held[2 + i], f))
            repeat = same_p & ((k != firsts[0]) | (t != firsts[1]) | (s != firsts[2]))
            held = [a[-1], p[-1], *(f[-1] for f in firsts)]
            if repeat.any():
                m = int(repeat.sum())
                yield spans([x[repeat] for x in (k, t, at, *firsts)], pa.nulls(m, pa.int64()))
            if last:
                return
            several = np.bincount(group, weights=~same_p, minlength=int(group.max(initial=0)) + 1) > 1
            up = ~repeat & (several[group] | ((at & 2) > 0))
            if branching is not None:
                up |= ~repeat & (a == branching)
            if up.any():
                yield spans([x[up] for x in (k, t, at, *firsts)], pa.array(a[up]))

        for b in batches:
            cols = [b[c].to_numpy(zero_copy_only=False) for c in _names(ROWS)]
            done = (cols[4] & 1) > 0
            if done.any():
                a, p, k, t, at, ss = (x[done] for x in cols)
                yield spans([k, t, at, a, p, ss], pa.nulls(len(k), pa.int64()))
                cols = [x[~done] for x in cols]
            if carry is not None:
                cols = [np.concatenate([x, y]) for x, y in zip(carry, cols, strict=True)]
                carry = None
            a = cols[0]
            if not len(a):
                continue
            cut_at = int(np.searchsorted(a, a[-1]))  # the last anchor's run may go on
            if last:
                yield from emit(cols)
            elif len(a) - cut_at > 200_000:  # too long to hold: it is sent on as branching, which only means a look at its windows
                branching = a[-1]
                yield from emit(cols)
            else:
                carry = [x[cut_at:] for x in cols]
                if cut_at:
                    yield from emit([x[:cut_at] for x in cols])
        if carry is not None and len(carry[0]):
            yield from emit(carry)

    return run


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of the spans at their coordinates in the texts, as ROWS."""
    for b in batches:
        ids, twins = (b[c].to_numpy(zero_copy_only=False) for c in ("id", "twin"))
        spans = b["spans"]
        for i, j, buf, off in tk.chunks(b["text"]):
            starts, ends, woff = tk.word_spans(buf, off)
            h = tk.word_hashes(buf, starts, ends)
            w, fits = tk.windows(h, woff, WINDOW)
            part = spans.slice(i, j - i)
            flat, lens = part.flatten(), np.asarray([len(x) if x is not None else 0 for x in part])
            d = np.repeat(np.arange(j - i), lens)
            s, z, a = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("start", "size", "anchor"))
            d, a, s0 = np.repeat(d, z), np.repeat(a, z), np.repeat(s, z)
            pos = s0 + np.arange(len(d)) - np.repeat(np.cumsum(z) - z, z)
            ok = woff[d] + pos < np.minimum(woff[d + 1], len(h))
            d, a, pos = d[ok], a[ok], pos[ok]
            at = woff[d] + pos
            ok = fits[at]
            d, a, pos, at = d[ok], a[ok], pos[ok], at[ok]
            if len(d):
                yield _batch(a, tk.signed(w[at]), ids[i + d], twins[i + d], pos, np.ones(len(d), np.int64), np.zeros(len(d), bool))


def _meet(rows: DataFrame, *keys: str) -> DataFrame:
    """Equal rows together and in order; those settled in their batches have no business with their keys any more and are dealt evenly."""
    deal = F.when(F.col("at").bitwiseAND(1) == 1, F.xxhash64("id", "at")).otherwise(F.xxhash64(*keys))
    return rows.repartition(deal).sortWithinPartitions("anchor", "path", "id", "twin", "at")


def _collect(spans: DataFrame, *fields: str) -> DataFrame:
    """A document's spans as one array; its own length bounds them."""
    return spans.groupBy("id", "twin").agg(F.collect_set(F.struct(*fields)).alias("spans"))


def repeats(texts: DataFrame) -> DataFrame:
    """(id, twin, start, size, sid, stwin, sstart): runs of windows that start earlier too, there, from texts (id, twin, text)."""
    found = cut(_meet(texts.mapInArrow(_paths, ROWS), "anchor").mapInArrow(_settle(False), SPANS))
    branching = _collect(found.filter("anchor IS NOT NULL"), "start", "size", "anchor")
    opened = texts.join(branching, ["id", "twin"]).select("id", "twin", "text", "spans").mapInArrow(_open, ROWS)
    again = _meet(opened, "anchor", "path").mapInArrow(_settle(True), SPANS)
    return found.filter("anchor IS NULL").union(again).drop("anchor")


MAXIMAL = "id long, twin long, start int, words int, sid long, stwin long, sstart int"


def _maximal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A document's runs of windows joined where they continue each other in the source as well."""
    for b in batches:
        spans = b["spans"]
        n = spans.value_lengths().to_numpy(zero_copy_only=False)
        flat = spans.flatten()
        s, z, sk, st, ss = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "size", "sid", "stwin", "sstart"))
        doc = np.repeat(np.arange(len(spans)), n)
        order = np.lexsort((s, s - ss, st, sk, doc))
        doc, s, z, sk, st, ss = (x[order] for x in (doc, s, z, sk, st, ss))
        if not len(s):
            continue
        new = np.ones(len(s), bool)
        # windows that start in or right behind the run before them; runs of one source and shift don't contain each other but for equal ones
        new[1:] = (doc[1:] != doc[:-1]) | (sk[1:] != sk[:-1]) | (st[1:] != st[:-1]) | (s[1:] - ss[1:] != s[:-1] - ss[:-1]) | (s[1:] > s[:-1] + z[:-1])
        head = np.flatnonzero(new)
        end = np.maximum.reduceat(s + z, head)
        cols = [b["id"].take(pa.array(doc[head])), b["twin"].take(pa.array(doc[head])), pa.array(s[head].astype(np.int32)), pa.array((end - s[head] + WINDOW - 1).astype(np.int32)), pa.array(sk[head]), pa.array(st[head]), pa.array(ss[head].astype(np.int32))]
        yield pa.RecordBatch.from_arrays(cols, _names(MAXIMAL))


DIGESTS = "sid long, stwin long, sstart int, words int, digest binary"


def _digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digests of the source spans, from the source texts."""
    for b in batches:
        rows = []
        for id_, twin, text, spans in zip(b[ID].to_pylist(), b[TWIN].to_pylist(), b["text"].cast(pa.string()), b[SPANS_AT].to_pylist(), strict=True):
            w = text.as_buffer().to_pybytes().split()
            rows += [(id_, twin, x["sstart"], x["words"], _digest(w[x["sstart"] : x["sstart"] + x["words"]])) for x in spans]
        if rows:
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], _names(DIGESTS))


#: names of what is found beside the documents' own columns
SPANS_AT, WORDS, REMOVED, SHA = "__row_spans", "__row_words", "__row_removed", "__row_sha256"


def _remove(texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with their verified spans taken out of the text, which is left out unless texts."""
        for b in batches:
            words, removed, digests, kept = [], [], [], []
            for text, spans in zip(b["text"].cast(pa.string()), b[SPANS_AT], strict=True):
                w = (text.as_buffer().to_pybytes() if text.is_valid else b"").split()
                gone = 0
                if spans.is_valid:
                    edge = np.zeros(len(w) + 1, np.int64)
                    for x in spans.as_py():
                        lo, hi = x["start"], x["start"] + x["words"]
                        if hi <= len(w) and _digest(w[lo:hi]) == x["digest"]:
                            edge[lo] += 1
                            edge[hi] -= 1
                    mask = np.cumsum(edge[:-1]) > 0
                    gone = int(mask.sum())
                    w = [x for x, m in zip(w, mask.tolist(), strict=True) if not m]
                out = b" ".join(w)
                words.append(len(w) + gone)
                removed.append(gone)
                digests.append(hashlib.sha256(out).hexdigest())
                if texts:
                    kept.append(out.decode() if gone else text.as_py())
            names = [c for c in b.schema.names if c not in (ID, TWIN, SPANS_AT) and (texts or c != "text")]
            cols = [pa.array(kept, pa.string()) if c == "text" else b[c] for c in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests)], [*names, WORDS, REMOVED, SHA])
        tk.give_back()

    return run


def judge_spans(told: DataFrame) -> DataFrame:
    """(ID, TWIN, SPANS_AT): each document's maximal repeated spans (start, words, digest of the source), from rows as of `told_apart`."""
    texts = told.select(F.col(ID).alias("id"), F.col(TWIN).alias("twin"), F.col("text").cast("string").alias("text"))
    spans = cut(_collect(repeats(texts), "start", "size", "sid", "stwin", "sstart").mapInArrow(_maximal, MAXIMAL))
    sources = _collect(spans.select(F.col("sid").alias("id"), F.col("stwin").alias("twin"), "sstart", "words").distinct(), "sstart", "words").toDF(ID, TWIN, SPANS_AT)
    # all columns go along, as they do in `cleaned`, so that the rows are dealt once for both
    digests = told.join(sources, [ID, TWIN]).mapInArrow(_digests, DIGESTS)
    digests = digests.groupBy("sid", "stwin", "sstart", "words").agg(F.min("digest").alias("digest"))  # equal rows give equal digests
    few = spans.limit(BROADCAST_SPANS + 1).count() <= BROADCAST_SPANS
    known = spans.join(F.broadcast(digests) if few else digests, ["sid", "stwin", "sstart", "words"])
    return _collect(known, "start", "words", "digest").toDF(ID, TWIN, SPANS_AT)


def cleaned(docs: DataFrame, texts: bool = True) -> DataFrame:
    """The rows with all their columns and WORDS, REMOVED and SHA; the text is what is kept, or left out unless texts.

    A text from which nothing goes is kept as it stands; else its kept words are joined by one space.
    """
    told = told_apart(docs)
    rows = told.join(judge_spans(told), [ID, TWIN], "left")
    fields = [T.StructField("text", T.StringType()) if f.name == "text" else f for f in docs.schema.fields if texts or f.name != "text"]
    return rows.mapInArrow(_remove(texts), T.StructType([*fields, T.StructField(WORDS, T.LongType()), T.StructField(REMOVED, T.LongType()), T.StructField(SHA, T.StringType())]))


def remove_repeats(docs: DataFrame, texts: bool = False) -> DataFrame:
    """One row for each document: doc_id, n_words, n_removed, kept_sha256, and with texts=True what is kept."""
    rows = cleaned(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), texts)
    return rows.select("doc_id", F.col(WORDS).alias("n_words"), F.col(REMOVED).alias("n_removed"), F.col(SHA).alias("kept_sha256"), *[F.col("text").alias("kept")] * texts)
