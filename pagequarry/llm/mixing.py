"""Mixing sources to target weights by temperature.

A source's weight is its share of all tokens to the power alpha, normalised.
Alpha 1 keeps the shares, alpha 0 makes all sources equal; the entropy of the
weights falls as alpha rises, and so does the largest number of epochs.  Alpha
is the largest value whose entropy still reaches the target, raised where a
source would otherwise be repeated more often than the limit allows.

The weights become budgets of tokens, and each budget whole epochs of the
source and a part of one more.  Every epoch is a permutation of the source's
documents (by the MD5 of document, epoch and seed), cut into blocks of about
`block_tokens`; blocks in turn are visited in the order of `block_key`.  With
no budget given, the total is the least at which no document is left out.

Everything runs as DataFrame operations.  A source may hold a third of all
rows: running sums go by the first digits of the permutation's key, so that a
window holds 1/4096 of a source's epoch.  The sources' totals stay distributed
too; the bisection collects at most `PROBES` rows a round.

Nulls and edges: very long texts count with all of their words.  A null text has no words, documents without words are kept
once, in epoch 0; null sources form a source of their own; equal documents
are told apart by doc_id, and rows that share a doc_id or have none by a key of
doc_id and text; their places among each other follow the key.  An
empty table gives an empty table.  Other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, ident, row_key

WORD = "[^\\x20\\x09-\\x0D]+"
#: candidates of a round, and rounds: the exponent is found to PROBES ** -ROUNDS
PROBES, ROUNDS = 64, 4
BROADCAST_SOURCES = 100_000
OUT = ["doc_id", "source", "n_tokens", "epoch", "block", "block_key", "tokens_before", "alpha", "weight", "budget_tokens"]


def key_of(source: str = "source") -> Column:
    """A key in which a null source differs from every text."""
    return F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n"))


def shares(sized: DataFrame) -> DataFrame:
    """(key, tokens, docs) of each source."""
    return sized.groupBy("key").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))


def exponent(sources: DataFrame, entropy_fraction: float, max_epochs: float, budget: int | None) -> float:
    """The exponent for the target, rounded to six digits.

    Each round weighs PROBES exponents of the bracket at once: sources stay distributed, and a row comes back for each exponent.
    """
    live = sources.filter("tokens > 0").select(F.ln(F.col("tokens").cast("double")).alias("lt"), F.col("tokens").cast("double").alias("t"))

    def fails(lo: float, hi: float, test: str) -> tuple[float, float]:
        """The neighbours between which the test, true at small exponents for entropy and at large ones for epochs, changes."""
        step = (hi - lo) / PROBES
        probes = F.explode(F.array(*[F.lit(lo + step * i) for i in range(PROBES + 1)])).alias("a")
        # scaled by the largest source so that no power overflows
        top = live.agg(F.max("lt").alias("top"))
        z = live.join(F.broadcast(top)).select(probes, F.col("lt") - F.col("top"), "t").toDF("a", "l", "t").withColumn("p", F.exp(F.col("a") * F.col("l")))
        # epochs of a source are budget * p / z / t; without a budget it is max(t/p) * max(p/t)
        total = F.max(F.col("t") / F.col("p")) if budget is None else F.lit(float(budget)) / F.sum("p")
        got = z.groupBy("a").agg(
            (F.ln(F.sum("p")) - F.sum(F.col("p") * F.col("a") * F.col("l")) / F.sum("p")).alias("h"), F.ln(F.count("*")).alias("hmax"), (total * F.max(F.col("p") / F.col("t"))).alias("epochs")
        )
        rows = sorted(got.select("a", F.expr(test).alias("ok")).collect())
        if not rows or rows[0].ok == rows[-1].ok:
            edge = lo if not rows or rows[0].ok == (test[0] == "e") else hi
            return edge, edge
        i = next(i for i, r in enumerate(rows) if r.ok != rows[0].ok)
        return rows[i - 1].a, rows[i].a

    best = 0.0
    for test in (f"h >= hmax * {entropy_fraction!r} - 1e-12", f"epochs <= {max_epochs!r} + 1e-9"):
        lo, hi = 0.0, 1.0
        for _ in range(ROUNDS):
            lo, hi = fails(lo, hi, test)
            if lo == hi:
                break
        best = max(best, lo if test[0] == "h" else hi)
    return round(best, 6)


def plan(sources: DataFrame, alpha: float, budget: int | None) -> DataFrame:
    """(key, tokens, weight, budget_tokens) of each source."""
    top = sources.agg(F.max("tokens").cast("double").alias("top"))
    p = sources.join(F.broadcast(top)).withColumn("p", F.when(F.col("tokens") > 0, F.exp(F.lit(alpha) * F.ln(F.col("tokens") / F.col("top")))).otherwise(0.0))
    z = p.agg(F.sum("p").alias("z"), F.max(F.when(F.col("p") > 0, F.col("tokens") / F.col("p"))).alias("most"))
    total = F.col("most") * F.col("p") if budget is None else F.lit(float(budget)) * F.col("p") / F.col("z")
    # a budget that is all but a whole number of epochs is rounded to it
    return p.join(F.broadcast(z)).select("key", "tokens", F.coalesce(F.col("p") / F.col("z"), F.lit(0.0)).alias("weight"), F.coalesce(F.floor(total + 0.001), F.lit(0)).cast("long").alias("budget_tokens"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """One row (OUT) for each time that a document is used; options as of `uses`."""
    return uses(docs, **options).select(*OUT)


def mixture(docs: DataFrame, **options) -> DataFrame:
    """The documents themselves, with all their columns, once for each use, and its place (OUT); equal rows are used alike."""
    placed = uses(docs, **options)
    own = [c for c in docs.columns if c not in OUT or c in ("doc_id", "source")]
    place = placed.groupBy(F.col("row").alias("__row_key"), "epoch").agg(*[F.min(c).alias(c) for c in OUT if c not in ("doc_id", "source", "epoch")])
    keyed = docs.select(*own, row_key().alias("__row_key"))
    return keyed.join(place, "__row_key").select(*own, *[c for c in OUT if c not in ("doc_id", "source")])


def uses(docs: DataFrame, entropy_fraction: float = 0.97, max_epochs: float = 4.0, budget: int | None = None, block_tokens: int = 1 << 20, seed: int = 0) -> DataFrame:
    """OUT for each time that a document is used, and row: its key."""
    sized = cut(docs.select(row_key().alias("row"), ident().alias("id"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), key_of().alias("key"), F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD)).cast("long").alias("n_tokens")))
    sources = cut(shares(sized))
    alpha = exponent(sources, entropy_fraction, max_epochs, budget)
    planned = plan(sources, alpha, budget).withColumn("full", F.when(F.col("tokens") > 0, F.floor(F.col("budget_tokens") / F.col("tokens"))).otherwise(0))
    planned = planned.withColumn("rest", F.col("budget_tokens") - F.col("full") * F.col("tokens"))
    # the plan has a row for each source: broadcast while they are few, which is counted, so that no source meets in one task
    used = sized.join(F.broadcast(planned) if sources.count() <= BROADCAST_SOURCES else planned, "key").withColumn("last", F.col("full") - F.when((F.col("rest") > 0) | (F.col("full") == 0), 0).otherwise(1))
    used = used.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("n_tokens") > 0, F.col("last")).otherwise(0))))
    used = used.withColumn("order_key", F.md5(F.concat_ws(":", F.col("id").cast("string"), F.col("epoch").cast("string"), F.lit(str(seed)))))
    used = used.withColumn("part", F.substring("order_key", 1, 3))
    group = ["key", "epoch"]
    parts = used.groupBy(*group, "part").agg(F.sum("n_tokens").alias("sum"))
    before = parts.select(*group, "part", (F.sum("sum").over(Window.partitionBy(*group).orderBy("part")) - F.col("sum")).alias("base"))
    inner = Window.partitionBy(*group, "part").orderBy("order_key", "id", "row").rowsBetween(Window.unboundedPreceding, -1)
    placed = used.join(before, [*group, "part"]).withColumn("tokens_before", F.col("base") + F.coalesce(F.sum("n_tokens").over(inner), F.lit(0)))
    kept = placed.filter((F.col("epoch") < F.col("full")) | (F.col("tokens_before") < F.col("rest")) | (F.col("n_tokens") == 0))
    kept = kept.withColumn("block", F.floor(F.col("tokens_before") / block_tokens).cast("long"))
    key = F.md5(F.concat_ws(":", "key", F.col("epoch").cast("string"), F.col("block").cast("string"), F.lit(str(seed))))
    return kept.withColumns({"block_key": key, "alpha": F.lit(alpha)}).select(*OUT, "row")
