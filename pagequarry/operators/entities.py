"""People, offers, quotes, questions, credentials and calls to action of a site, from its pages' own rows.

Inputs are rows of one relation of `parsed` with (site keys, ord, page_type, pos,
fields); of the same entry on several pages the preferred page's stays, else the
first in crawl order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .extract import credentials
from .order import keep_first, top
from .profile import preferred_first
from .resolve import gender


def _first(rows: DataFrame, keys: list[str], types: list[str], same: Column, k: int) -> DataFrame:
    return preferred_first(rows.withColumn("ord", F.struct("ord", "tier", "pos") if "tier" in rows.columns else F.struct("ord", "pos")), keys, types, same, k)


def key_people(people: DataFrame, keys: list[str], k: int = 40) -> DataFrame:
    """(keys, place, name, title, gender, bio): those of team and about pages alone, team pages first; gender only from a bio's own pronouns."""
    of_staff = people.filter(F.col("page_type").isin("team", "about"))
    kept = _first(of_staff, keys, ["team"], F.lower(F.trim(F.coalesce("name", "title", F.lit("")))), k)
    return kept.select(*keys, "place", "name", "title", gender(F.col("pronouns")).alias("gender"), "bio")


def offers(rows: DataFrame, keys: list[str], k: int = 60) -> DataFrame:
    """(keys, place, name, category, description, price): services pages first."""
    kept = _first(rows, keys, ["services"], F.lower(F.trim(F.coalesce("name", F.lit("")))), k)
    return kept.select(*keys, "place", "name", "category", "description", "price")


def quotes(rows: DataFrame, keys: list[str], k: int = 30) -> DataFrame:
    """(keys, place, quote, attributed_to): testimonial pages first."""
    kept = _first(rows, keys, ["testimonials"], F.lower(F.substring(F.coalesce("quote", F.lit("")), 1, 120)), k)
    return kept.select(*keys, "place", "quote", "attributed_to")


def questions(rows: DataFrame, keys: list[str], k: int = 40) -> DataFrame:
    """(keys, place, question, answer): pages of questions first."""
    kept = _first(rows, keys, ["faq"], F.lower(F.trim(F.coalesce("question", F.lit("")))), k)
    return kept.select(*keys, "place", "question", "answer")


def certificates(rows: DataFrame, keys: list[str], k: int = 25) -> DataFrame:
    """(keys, place, name, year): credentials in the pages' texts that may hold some."""
    named = credentials(rows.withColumnRenamed("pos", "block"), [*keys, "ord", "block"])
    once = keep_first(named.withColumn("__same", F.lower("name")), [*keys, "__same"], ["ord", "block", "pos"])
    return top(once, keys, ["ord", "block", "pos"], k, "place").select(*keys, "place", "name", "year")


def actions(ctas: DataFrame, contacts: DataFrame, keys: list[str], k: int = 30) -> DataFrame:
    """(keys, place, kind, label, href): the pages' calls to action with where they lead, then telephone numbers and mail addresses (contacts: kind, value) that no call has."""
    own = ctas.select(*keys, F.lit(0).alias("tier"), "ord", F.lit(0).alias("group"), "pos", "kind", "label", "href")
    phone = F.col("kind") == "phone"
    href = F.when(phone, F.concat(F.lit("tel:"), F.regexp_replace("value", r"[^\d+]", ""))).otherwise(F.concat(F.lit("mailto:"), "value"))
    said = contacts.filter(F.col("kind").isin("phone", "email")).select(*keys, F.lit(1).alias("tier"), "ord", F.when(phone, 0).otherwise(1).alias("group"), "pos", F.when(phone, "tel").otherwise("mailto").alias("kind"), F.col("value").alias("label"), href.alias("href"))
    rows = own.unionByName(said).withColumn("__same", F.concat_ws("::", "kind", F.lower(F.coalesce("label", F.lit("")))))
    order = ["tier", "ord", "group", "pos"]
    return top(keep_first(rows, [*keys, "__same"], order), keys, order, k, "place").select(*keys, "place", "kind", "label", "href")


def common_category(rows: DataFrame, keys: list[str], generic: list[str]) -> DataFrame:
    """(keys, category): the offers' most frequent category as first written, generic ones left out, if it recurs or is the only one."""
    own = rows.withColumn("category", tx.null_if_blank(F.col("category"))).withColumn("low", F.lower("category")).filter(F.col("category").isNotNull() & ~F.col("low").isin(generic))
    counted = own.groupBy(*keys, "low").agg(F.count("*").alias("n"), F.min(F.struct("place", "category")).alias("first"))
    best = counted.groupBy(*keys).agg(F.count("*").alias("kinds"), F.min(F.struct((-F.col("n")).alias("n"), "first")).alias("b"))
    return best.filter("b.n <= -2 OR kinds = 1").select(*keys, F.col("b.first.category").alias("category"))
