"""Hard negatives by a two-dimensional block product of anchors and rows.

Rows and anchors are dealt over blocks of `LEFT` anchors and `RIGHT` rows, their
dimensions over chunks.  Each block of anchors meets each block of rows chunk by
chunk; the partial tiles of scores (64-bit integers) are shuffled to their place
in the grid and added up there, and each whole tile is reduced at once to the
first few rows of every anchor, so that no table of scores is kept.

1. Positives: the product within each label, reduced to an anchor's first rows,
   first in each tile, then over all tiles.
2. Negatives: the product of all anchors that have positives with all rows; a
   tile keeps for every positive the first rows of other labels in its window,
   and a second ranking takes the first of all tiles.

Blocks are dealt by a row number that is written down before, so that a block
has about as many rows whatever a label's or a vector's share, and a task that
runs again finds the same blocks.  A group holds the chunks of one tile, which
are `CHUNKS` at most.

Defined cases: rows with a null label, a null vector, or a null or non-finite
component take no part.  A shorter vector counts as if 0 stood in its missing
places.  Components are bounded to what keeps a score under 2**55 in absolute
value (2**24.5 with 64 dimensions).  Each row with an anchor's identifier is an
anchor of its own, and a repeated row is another row.  Rows without an
identifier are no anchors; they come last among equal scores, and stand as null
in the result.  Of ties that agree in the identifier as well, those that stand
first in the written table go first.  Anchors without positives, and positives
without negatives, give no rows, and empty tables none.  No column but the
identifier, the vector and the label is read, whatever the others are named.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .vectors import scaled, usable

#: anchors and rows of a block, dimensions of a chunk at least, chunks at most
LEFT, RIGHT, CHUNK, CHUNKS = 256, 2048, 32, 8
#: partial scores below this are exact in doubles
EXACT = 1 << 53
_BLOCK = "g long, b long, dc int, rid binary, id binary, nil binary, label binary, windows binary, matrix binary"
_TILE = "g long, i long, j long, dc int, tile binary, left binary, right binary, windows binary"
_FIRST = "anchor long, anchor_id long, place long, other_id long, other_nil long, other_score long, rid long, id long, nil long, score long"


def prepared(rows: DataFrame, ident: str = "vec_id", vector: str = "embedding", label: Column | None = None) -> DataFrame:
    """(rid, id, nil, label, x): the rows that take part, numbered and written to the shared folder."""
    label = F.col("label") if label is None else label
    out = rows.select(F.col(ident).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector).alias("v")).filter(F.col("label").isNotNull() & usable("v"))
    return stored(out.select(F.monotonically_increasing_id().alias("rid"), F.coalesce("id", F.lit(0)).alias("id"), F.col("id").isNull().cast("long").alias("nil"), "label", scaled("v").alias("x")))


def chunks(dim: int) -> list[tuple[int, int]]:
    """The dimensions in at most CHUNKS spans."""
    step = max(CHUNK, -(-dim // CHUNKS))
    return [(at, min(at + step, dim)) for at in range(0, dim, step)]


def _blocks(rows: DataFrame, sizes: DataFrame, count: str, dim: int, most: int) -> DataFrame:
    """The rows (g, rid, id, nil, label, x, and an anchor's windows) in blocks, each a row for every chunk of dimensions."""
    spans, kind = chunks(dim), "<i4" if most < 1 << 31 else "<i8"

    def pack(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("rid", ignore_index=True)
        whole = np.zeros((len(part), dim), dtype=np.int64)
        for i, x in enumerate(part["x"]):
            whole[i, : len(x)] = x
        np.clip(whole, -most, most, out=whole)
        windows = [(i, place, *w) for i, row in enumerate(zip(part["other_id"], part["other_nil"], part["other_score"], strict=True)) for place, w in enumerate(zip(*row, strict=True))]
        about = {c: part[c].to_numpy(np.int64).tobytes() for c in ("rid", "id", "nil", "label")} | {"windows": np.array(windows, dtype=np.int64).tobytes()}
        return pd.DataFrame([{"g": key[0], "b": key[1], "dc": k, "matrix": whole[:, at:to].astype(kind).tobytes()} | (dict.fromkeys(about, b"") if k else about) for k, (at, to) in enumerate(spans)])

    dealt = rows.join(sizes, "g").withColumn("b", F.pmod(F.xxhash64("rid"), F.col(count)))
    return dealt.groupBy("g", "b").applyInPandas(pack, _BLOCK)


def _first(k: int, fits: np.ndarray, scores: np.ndarray, about: np.ndarray) -> np.ndarray:
    """The places of the first k rows that fit: higher scores first, then identifiers, those without one last."""
    at = np.flatnonzero(fits)
    if len(at) > k:
        own = scores[at]
        at = at[own >= np.partition(own, len(own) - k)[len(own) - k]]
    rid, ident, nil = about[0, at], about[1, at], about[2, at]
    return at[np.lexsort((rid, ident, nil, -scores[at]))[:k]]


def _product(left: DataFrame, right: DataFrame, sizes: DataFrame, dim: int, most: int, reduce_tile) -> DataFrame:
    """What `reduce_tile` makes of every tile of scores between the blocks of both sides."""
    spans, kind = chunks(dim), "<i4" if most < 1 << 31 else "<i8"

    def multiply(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame(columns=["g", "i", "j", "dc", "tile", "left", "right", "windows"])
        a, b = a.iloc[0], b.iloc[0]
        at, to = spans[key[3]]
        x, y = (np.frombuffer(m, dtype=kind).reshape(-1, to - at) for m in (a["matrix"], b["matrix"]))
        exact = (to - at) * most * most < EXACT
        tile = (x.astype(float) @ y.T.astype(float)).astype(np.int64) if exact else x.astype(np.int64) @ y.T.astype(np.int64)
        both = [b"".join(s[c] for c in ("rid", "id", "nil", "label")) for s in (a, b)]
        return pd.DataFrame([(*key, tile.tobytes(), *both, a["windows"])], columns=["g", "i", "j", "dc", "tile", "left", "right", "windows"])

    def add_up(key: tuple, tiles: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(t, dtype=np.int64) for t in tiles["tile"])
        about = tiles.loc[tiles["dc"].idxmin()]
        a, b = (np.frombuffer(about[s], dtype=np.int64).reshape(4, -1) for s in ("left", "right"))
        windows = np.frombuffer(about["windows"], dtype=np.int64).reshape(-1, 5)
        found = reduce_tile(total.reshape(a.shape[1], b.shape[1]), a, b, windows)
        return pd.DataFrame(found, columns=[x.split()[0] for x in _FIRST.split(", ")]).astype("int64")

    grid = F.broadcast(sizes) if sizes.count() <= 100_000 else sizes
    rows = left.join(grid, "g").select("g", F.col("b").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_right") - 1)).alias("j"), "dc", *[F.col(c) for c in ("rid", "id", "nil", "label", "windows", "matrix")])
    columns = right.join(grid, "g").select("g", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_left") - 1)).alias("i"), F.col("b").alias("j"), "dc", *[F.col(c) for c in ("rid", "id", "nil", "label", "matrix")])
    tiles = rows.groupBy("g", "i", "j", "dc").cogroup(columns.groupBy("g", "i", "j", "dc")).applyInPandas(multiply, _TILE)
    return tiles.groupBy("g", "i", "j").applyInPandas(add_up, _FIRST)


def _sizes(left: DataFrame, right: DataFrame) -> DataFrame:
    """How many blocks each group has on both sides, for groups that have both."""
    n = lambda rows, side, name: rows.groupBy("g").agg(F.ceil(F.count("*") / side).alias(name))
    return stored(n(left, LEFT, "n_left").join(n(right, RIGHT, "n_right"), "g"))


def _ranked(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = [F.desc("score"), "nil", "id", "rid"]
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)


def mine(rows: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for `prepared` rows: the anchors are those whose id `every` divides, and a negative's score is between `low` and `high` percent of the positive's."""
    size = rows.agg(F.max(F.size("x")).alias("dim"), F.max(F.array_max("x")).alias("hi"), F.min(F.array_min("x")).alias("lo")).first()
    dim = max(size.dim or 0, 1)
    most = max(1, min(max(abs(size.hi or 0), abs(size.lo or 0)), int((2**55 / dim) ** 0.5)))

    def nearest(scores, a, b, windows):
        for i in range(len(scores)):
            for j in _first(positives, b[0] != a[0, i], scores[i], b):
                yield (a[0, i], a[1, i], 0, 0, 0, 0, b[0, j], b[1, j], b[2, j], scores[i, j])

    def hardest(scores, a, b, windows):
        for i, place, other, nil, score in windows:
            fits = (b[3] != a[3, i]) & (scores[i] >= -(-low * score // 100)) & (scores[i] <= high * score // 100)
            for j in _first(negatives, fits, scores[i], b):
                yield (a[0, i], a[1, i], place, other, nil, score, b[0, j], b[1, j], b[2, j], scores[i, j])

    def block(kind, *columns):
        return [F.col(c) for c in ("rid", "id", "nil", "label", "x")] + [kind.alias("g"), *columns]

    none = [F.array().cast("array<long>").alias(c) for c in ("other_id", "other_nil", "other_score")]
    anchors = rows.filter((F.col("nil") == 0) & (F.col("id") % every == 0))
    left, right = anchors.select(block(F.col("label"), *none)), rows.select(block(F.col("label"), *none))
    sizes = _sizes(left, right)
    found = _product(_blocks(left, sizes, "n_left", dim, most), _blocks(right, sizes, "n_right", dim, most), sizes, dim, most, nearest)
    first = stored(_ranked(found, ["anchor"], positives).select("anchor", "rank", "id", "nil", "score"))

    windows = first.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "nil", "score"))).alias("w"))
    with_windows = anchors.join(windows.select(F.col("anchor").alias("rid"), F.col("w.id").alias("other_id"), F.col("w.nil").alias("other_nil"), F.col("w.score").alias("other_score")), "rid")
    left, right = stored(with_windows.select(block(F.lit(0).cast("long"), "other_id", "other_nil", "other_score"))), rows.select(block(F.lit(0).cast("long"), *none))
    sizes = _sizes(left, right)
    found = _product(_blocks(left, sizes, "n_left", dim, most), _blocks(right, sizes, "n_right", dim, most), sizes, dim, most, hardest)
    named = lambda c, nil: F.when(F.col(nil) == 0, F.col(c))
    return _ranked(found, ["anchor", "place"], negatives).select("anchor_id", named("other_id", "other_nil").alias("positive_id"), "rank", named("id", "nil").alias("negative_id"), F.col("other_score").alias("positive_score"), F.col("score").alias("negative_score"))
