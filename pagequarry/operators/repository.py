"""Companies and their profile snapshots on DataFrames: save, list, search, versions, delete, facets.

There is no transaction; each operator takes tables and returns tables, and a
sink swaps them in (`sources.tables`).  A snapshot has (id, company_id,
created_at, seq, status, is_current, …); seq breaks ties of created_at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from .order import top

KEEP = 5


def _newest() -> list[Column]:
    return [F.desc("created_at"), F.desc("seq")]


def retain(kbs: DataFrame, k: int = KEEP) -> DataFrame:
    """The k newest snapshots of each company."""
    return top(kbs, ["company_id"], _newest(), k, "version_no")


def current(kbs: DataFrame) -> DataFrame:
    return top(kbs, ["company_id"], _newest(), 1)


def versions(kbs: DataFrame) -> DataFrame:
    """All snapshots but the current one, newest first, numbered."""
    return retain(kbs, 1 << 30).filter("version_no > 1")


def upsert_companies(companies: DataFrame, incoming: DataFrame) -> DataFrame:
    """Companies (id, name, canonical_website) with incoming (id, name, website): known websites are renamed, others added."""
    new = incoming.select(F.col("id").alias("new_id"), F.col("name").alias("new_name"), urls.canonical_website(F.col("website")).alias("canonical_website"))
    return companies.join(new, "canonical_website", "full_outer").select(F.coalesce("id", "new_id").alias("id"), F.coalesce("new_name", "name").alias("name"), "canonical_website")


def save(kbs: DataFrame, incoming: DataFrame, k: int = KEEP) -> DataFrame:
    """Snapshots after incoming ones: those are current, older ones of their companies aren't, and k of each company stay."""
    fresh = incoming.select("company_id").distinct().withColumn("fresh", F.lit(True))
    old = kbs.join(fresh, "company_id", "left").withColumn("is_current", F.col("is_current") & F.col("fresh").isNull()).drop("fresh")
    return retain(old.unionByName(incoming.withColumn("is_current", F.lit(True))), k).drop("version_no")


def listing(kbs: DataFrame, industry: str | None = None, language: str | None = None, search: str | None = None, deleted: bool = False, texts: tuple[str, ...] = ("name",), people: str | None = None) -> DataFrame:
    """Current snapshots that pass the filters; an empty filter passes all. search looks for a part of any of the texts or of a person's name, in any case."""
    out = kbs.filter("is_current")
    out = out if deleted else out.filter("status = 'active'")
    if industry:
        out = out.filter(F.col("industry") == industry)
    if language:
        out = out.filter(F.array_contains("languages", language))
    if search and (needle := search.strip().lower()):
        hit = F.contains(F.lower(F.coalesce(F.col(texts[0]), F.lit(""))), F.lit(needle))
        for t in texts[1:]:
            hit = hit | F.contains(F.lower(F.coalesce(F.col(t), F.lit(""))), F.lit(needle))
        if people:
            hit = hit | F.coalesce(F.exists(people, lambda p: F.contains(F.lower(p["name"]), F.lit(needle))), F.lit(False))
        out = out.filter(hit)
    return out


def people_named(kbs: DataFrame, people: str, pattern: str) -> DataFrame:
    """Snapshots with a person whose name matches a pattern in any case."""
    return kbs.filter(F.coalesce(F.exists(people, lambda p: p["name"].rlike("(?i)" + pattern)), F.lit(False)))


def set_status(kbs: DataFrame, ids: DataFrame, status: str, at: Column) -> DataFrame:
    """Soft delete and restore: the status and updated_at of the given ids; unknown ids change nothing."""
    hit = kbs.join(ids.select("id").distinct().withColumn("hit", F.lit(True)), "id", "left")
    return hit.withColumn("status", F.when(F.col("hit"), status).otherwise(F.col("status"))).withColumn("updated_at", F.when(F.col("hit"), at).otherwise(F.col("updated_at"))).drop("hit")


def hard_delete(companies: DataFrame, kbs: DataFrame, sections: DataFrame, ids: DataFrame, promote: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tables without the given snapshots, their sections, and companies without snapshots; promote makes the newest left current."""
    left = kbs.join(ids, "id", "left_anti")
    if promote:
        w = Window.partitionBy("company_id").orderBy(*_newest())
        left = left.withColumn("is_current", F.row_number().over(w) == 1)
    return companies.join(left.select(F.col("company_id").alias("id")), "id", "left_semi"), left, sections.join(ids.select(F.col("id").alias("kb_id")), "kb_id", "left_anti")


def set_sections(sections: DataFrame, changes: DataFrame) -> DataFrame:
    """Section states (kb_id, section, hidden, hidden_at) after changes of the same form; hidden_at is null for shown ones."""
    new = changes.select("kb_id", "section", F.col("hidden").alias("h"), F.when(F.col("hidden"), F.col("hidden_at")).alias("a"))
    return sections.join(new, ["kb_id", "section"], "full_outer").select("kb_id", "section", F.coalesce("h", "hidden").alias("hidden"), F.when(F.col("h").isNull(), F.col("hidden_at")).otherwise(F.col("a")).alias("hidden_at"))


def facets(kbs: DataFrame) -> DataFrame:
    """(kind, value): the distinct industries and languages of current snapshots, deleted ones included."""
    now = kbs.filter("is_current")
    both = now.select(F.lit("industry").alias("kind"), F.col("industry").alias("value")).union(now.select(F.lit("language"), F.explode("languages")))
    return both.filter(F.length("value") > 0).distinct()
