"""Embedding whitening from one aggregation over all pairs of dimensions.

`fit` scales the components to integers, keeps each distinct vector once, sums
every dimension exactly, and sums the centred products of every pair of the
upper triangle in one aggregation of generated SQL expressions.  The triangle is
cut into blocks of `SIDE` times `SIDE` pairs, which are the groups: so the plan has
as many expressions for any number of dimensions, and tasks send one row of sums
a block.  The covariance is put together on the driver (its size is that of the
dimensions alone, `MAX_DIM` at most) and decomposed by LAPACK.  `whiten` projects
each row on the first components by generated expressions, so that no row leaves
the JVM; what the transform makes of the fitted vectors is measured again.

Defined cases: rows whose vector is null, or holds null or non-finite entries,
are dropped, as are those of another length than most (`vectors.common_length`),
and all if that length is 0.  Repeated vectors count once for the fit, and every
row has its results, also rows without a vec_id, and repeated ones.  Components
whose eigenvalue is not over `LEAST` of the largest have no whitened value and are
left out, so that a table with a single distinct vector, like an empty one, gives
no rows.  `deviation` is null where it doesn't fit a long.  No column but the
identifier and the vector is read, whatever the others are named.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .vectors import common_length, scaled, usable

#: dimensions at most, whose covariance the driver holds
MAX_DIM = 4096
#: pairs are summed in blocks of so many dimensions
SIDE = 16
#: eigenvalues below this share of the largest are noise of the arithmetic
LEAST = 1e-10
X = "__x"


@dataclass(frozen=True)
class Whitening:
    """A fitted transform: its first components (rows of `axes`) with their eigenvalues, and the fit list's exact sums."""

    n: int
    sums: list[int]
    most: int
    values: np.ndarray
    axes: np.ndarray
    trace: float
    identity_error: float = 0.0

    def projections(self) -> list[Column]:
        """The whitened value on each component, as expressions over X."""
        centred = [F.col(X)[i].cast("double") - s / self.n for i, s in enumerate(self.sums)]
        return [reduce(add, [c * float(a) for c, a in zip(centred, axis, strict=True)]) / math.sqrt(e) for axis, e in zip(self.axes, self.values, strict=True)]

    def deviation(self) -> Column:
        """The sum over the dimensions of (n * x - S) squared: as longs where no row can be beyond them, else as decimals."""
        if len(self.sums) * (2 * self.n * self.most) ** 2 < 1 << 63:
            return reduce(add, [(F.lit(self.n) * F.col(X)[i] - F.lit(s)) * (F.lit(self.n) * F.col(X)[i] - F.lit(s)) for i, s in enumerate(self.sums)])
        apart = [F.lit(self.n).cast("decimal(19,0)") * F.col(X)[i].cast("decimal(19,0)") - F.lit(str(s)).cast("decimal(38,0)") for i, s in enumerate(self.sums)]
        near = [F.when(F.abs(a) < 1 << 32, a.cast("bigint")) for a in apart]  # beyond that a square is no long
        total = reduce(add, [(a * a).cast("decimal(38,0)") for a in near])
        return F.when(total < F.lit(str(1 << 63)).cast("decimal(38,0)"), total.cast("bigint"))


def _points(rows: DataFrame, dim: int, vector: str, *keep: str) -> DataFrame:
    """The usable rows of the dimension: the kept columns and the scaled vector."""
    return rows.select(*keep, vector).filter(usable(vector) & (F.size(vector) == dim)).select(*keep, scaled(vector).alias(X))


def _pair_sums(points: DataFrame, means: list[float]) -> np.ndarray:
    """The sums of centred products of all pairs of dimensions."""
    dim = len(means)
    blocks = -(-dim // SIDE)
    wide = F.array(*[F.col(X)[i].cast("double") - m for i, m in enumerate(means)], *[F.lit(0.0)] * (blocks * SIDE - dim))
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(blocks) for j in range(i, blocks)]))
    cells = points.select(wide.alias("c")).select("c", pairs.alias("p")).select(
        "p.i", "p.j", *[F.expr(f"c[p.i * {SIDE} + {k}]").alias(f"a{k}") for k in range(SIDE)], *[F.expr(f"c[p.j * {SIDE} + {k}]").alias(f"b{k}") for k in range(SIDE)]
    )
    sums = cells.groupBy("i", "j").agg(*[F.expr(f"sum(a{k} * b{m})") for k in range(SIDE) for m in range(SIDE)]).collect()
    out = np.zeros((blocks * SIDE, blocks * SIDE))
    for row in sums:
        i, j = row[0] * SIDE, row[1] * SIDE
        tile = np.array(row[2:], dtype=float).reshape(SIDE, SIDE)
        out[i : i + SIDE, j : j + SIDE] = tile
        out[j : j + SIDE, i : i + SIDE] = tile.T
    return out[:dim, :dim]


def _identity_error(points: DataFrame, model: Whitening) -> float:
    """The largest entry of the whitened vectors' covariance, less the identity."""
    k = len(model.values)
    w = points.select(*[p.alias(f"w{i}") for i, p in enumerate(model.projections())])
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    row = w.agg(*[F.expr(f"sum(w{i})") for i in range(k)], *[F.expr(f"sum(w{i} * w{j})") for i, j in pairs]).first()
    means = [x / model.n for x in row[:k]]
    return max(abs(s / model.n - means[i] * means[j] - (i == j)) for s, (i, j) in zip(row[k:], pairs, strict=True))


def fit(rows: DataFrame, keep: int = 4, vector: str = "embedding") -> Whitening | None:
    """The transform to the first `keep` components, or None where no component has a spread."""
    dim = common_length(rows.filter(usable(vector)), vector)
    if not dim:
        return None
    if dim > MAX_DIM:
        raise ValueError(f"{dim} dimensions are over {MAX_DIM}")
    points = stored(_points(rows, dim, vector).distinct())
    size = points.agg(F.count("*").alias("n"), F.max(F.array_max(X)).alias("hi"), F.min(F.array_min(X)).alias("lo")).first()
    most = max(abs(size.hi), abs(size.lo), 1)
    kind = "bigint" if size.n * most < 1 << 62 else "decimal(38,0)"
    sums = [int(x) for x in points.agg(*[F.sum(F.col(X)[i].cast(kind)) for i in range(dim)]).first()]
    covariance = _pair_sums(points, [s / size.n for s in sums]) / size.n
    values, axes = np.linalg.eigh(covariance)
    order = [i for i in np.argsort(-values)[:keep] if values[i] > LEAST * values.max()]
    if not order or values.max() <= 0:
        return None
    model = Whitening(size.n, sums, most, values[order], axes[:, order].T, float(np.trace(covariance)))
    return replace(model, identity_error=_identity_error(points, model))


def whiten(rows: DataFrame, model: Whitening | None, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(ident, component, n, deviation, whitened, explained, identity_error) for each usable row and component."""
    if model is None:
        return rows.select(ident, F.lit(0).alias("component"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("deviation"), F.lit(0.0).alias("whitened"), F.lit(0.0).alias("explained"), F.lit(0.0).alias("identity_error")).limit(0)
    parts = [F.struct(F.lit(i).alias("component"), p.alias("whitened"), F.lit(float(e) / model.trace).alias("explained")) for i, (p, e) in enumerate(zip(model.projections(), model.values, strict=True), 1)]
    placed = _points(rows, len(model.sums), vector, ident).select(ident, model.deviation().alias("deviation"), F.explode(F.array(*parts)).alias("p"))
    return placed.select(ident, "p.component", F.lit(model.n).cast("long").alias("n"), "deviation", "p.whitened", "p.explained", F.lit(model.identity_error).alias("identity_error"))
