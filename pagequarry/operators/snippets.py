"""A site's texts as one table: headings, paragraphs and list items in one total order.

Every field that is read from prose reads this table.  Rows are (site keys, ord,
page_type, kind, level, pos, text): text is what is visible, page chrome is left
out, and (ord, kind, pos) orders a site's rows: a page's headings come first,
then its paragraphs, then its items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dictionaries as di
from ..functions import matcher
from ..functions import text as tx
from . import parsed
from .order import keep_first, top

KINDS = ["heading", "paragraph", "item"]
ORDER = ["ord", "kind_rank", "pos"]


def _page_keys(rows: DataFrame) -> list[str]:
    return [c for c in rows.columns if c not in parsed.RELATIONS and c not in ("relation", "pos")]


def blocks(rows: DataFrame, headings: int = 60, items: int = 120, longest_item: int = 200) -> DataFrame:
    """The snippets of rows parsed with heading, main and item: the first `headings` of a page, all its paragraphs, and its first different items that are shorter than `longest_item`."""
    page, there = _page_keys(rows), [r for r in ("heading", "main", "item") if r in rows.columns]
    text, is_ = F.coalesce(*[F.col(f"{r}.text") for r in there]), lambda k: F.col("kind") == k
    kind = F.when(F.col("relation") == "main", "paragraph").when(F.col("relation").isin("heading", "item"), F.col("relation"))
    level = F.col("heading.level") if "heading" in there else F.lit(None).cast("int")
    # a text is cleaned and judged once: filters over it would write both into each other, and work them out again wherever they are named
    fit = F.filter(F.array(tx.visible(text)), lambda x: (F.length(x) > 0) & tx.noise_reason(x, di.NOISE_EXACT, di.NOISE_CONTAINS).isNull())
    all_ = rows.select(*page, "pos", kind.alias("kind"), level.alias("level"), F.explode(fit).alias("text")).filter(F.col("kind").isNotNull())
    shown = all_.filter(~is_("item") | (F.length("text") < longest_item))
    out = shown
    if {"heading", "item"} & set(there):  # paragraphs are neither counted nor compared
        first = shown
        if "item" in there:  # items alone are compared
            first = shown.withColumn("__nth", F.row_number().over(Window.partitionBy(*page, "kind", "text").orderBy("pos"))).filter(~is_("item") | (F.col("__nth") == 1))
        room = F.when(is_("heading"), headings).when(is_("item"), items)
        out = first.withColumn("__nth", F.row_number().over(Window.partitionBy(*page, "kind").orderBy("pos"))).filter(room.isNull() | (F.col("__nth") <= room)).drop("__nth")
    return out.withColumn("kind_rank", F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int"))


def prose(snippets: DataFrame) -> DataFrame:
    """The paragraphs that are passages: two words and twelve visible characters at least."""
    return snippets.filter((F.col("kind") == "paragraph") & tx.substantive(F.col("text")))


def with_signals(snippets: DataFrame, signals: dict[str, list[str]] = di.SIGNALS) -> DataFrame:
    """The snippets with the names of the signal lists of which they have a phrase (signals): all lists in one pass."""
    lists = matcher.Phrases({"signals": signals})
    return snippets.withColumn("__hits", lists.hits(F.col("text"))).withColumn("signals", lists.labels(F.col("__hits"), "signals")).drop("__hits")


def passages_with_signals(rows: DataFrame, signals: dict[str, list[str]]) -> DataFrame:
    """What `with_signals` gives of the passages of rows parsed with main, where it gives any; only texts that have a phrase are judged, which costs far more than to look for one."""
    page, text = _page_keys(rows), F.col("text")
    said = with_signals(rows.filter(F.col("relation") == "main").select(*page, "pos", F.explode(F.array(tx.visible(F.col("main.text")))).alias("text")), signals)
    # one condition, so that its second part isn't asked before the first
    fit = F.when(F.size("signals") > 0, (F.length("text") > 0) & tx.noise_reason(text, di.NOISE_EXACT, di.NOISE_CONTAINS).isNull() & tx.substantive(text))
    return said.filter(fit).withColumns({"kind": F.lit("paragraph"), "kind_rank": F.lit(KINDS.index("paragraph") + 1)})


def hero(snippets: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, text): each site's first h1 or h2 of its homepage, if it is a passage."""
    first = snippets.filter("kind = 'heading' AND level <= 2 AND page_type = 'homepage'").groupBy(*keys).agg(F.min_by("text", F.struct(*ORDER)).alias("text"))
    return first.filter(tx.substantive(F.col("text")))


def positioning(snippets: DataFrame, declared: DataFrame, keys: list[str], first: list[str], k: int = 3) -> DataFrame:
    """(keys, place, kind, text): the first k passages of a site's own words, kinds in the order of `first`: about, hero, homepage (its first three) and declared (keys, text), which comes last if it was cut off; repeats go."""
    said = prose(snippets)
    about = said.filter("page_type = 'about'").select(*keys, F.lit("about").alias("kind"), F.struct(*ORDER).alias("at"), "text")
    home = top(said.filter("page_type = 'homepage'"), keys, ORDER, 3).select(*keys, F.lit("homepage").alias("kind"), F.struct(*ORDER).alias("at"), "text")
    none = F.lit(None).cast(about.schema["at"].dataType).alias("at")
    top_line = hero(snippets, keys).select(*keys, F.lit("hero").alias("kind"), none, "text")
    own = declared.filter(tx.has_visible(F.col("text"))).select(*keys, F.lit("declared").alias("kind"), none, tx.visible(F.col("text")).alias("text"))
    rank = F.array_position(F.array(*[F.lit(x) for x in first]), F.col("kind"))
    pool = about.unionByName(home).unionByName(top_line).unionByName(own)
    ranked = pool.withColumn("rank", F.when((F.col("kind") == "declared") & tx.truncated(F.col("text")), len(first) + 1).otherwise(rank))
    kept = keep_first(ranked.withColumn("__same", F.lower(F.substring("text", 1, 160))), [*keys, "__same"], ["rank", "at"])
    return top(kept, keys, ["rank", "at"], k, "place").select(*keys, "place", "kind", "text")
