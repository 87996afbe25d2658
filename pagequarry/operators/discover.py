"""Which pages of a site to read: classification of links, budgets, probes, and failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import matcher, urls
from ..functions import text as tx
from .order import keep_first, top

#: the order in which kinds of pages are read
PRIORITY = ["about", "services", "contact", "pricing", "team", "testimonials", "faq", "blog"]


def page_types(link_text: Column, url: Column, keywords: dict[str, list[str]]) -> Column:
    """The types whose keywords stand as whole words, singular or plural, in a link's text or its address' path: one pass for all keywords."""
    path = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", ""), r"[?#].*", "")
    lists = matcher.Words({"types": keywords})
    return lists.labels(lists.hits(F.coalesce(link_text, F.lit("")), path), "types")


def navigation(rows: DataFrame, keys: list[str], url: str = "url") -> DataFrame:
    """(keys, region, pos, target, text, via) of a page's navigation links (region, pos, href, text): absolute ones of the page's own site, region by region, repeats kept."""
    target = urls.resolve(F.col("href"), F.col(url))
    own = rows.withColumn("target", target).filter(F.col("target").isNotNull() & urls.same_site(F.col("target"), F.col(url)))
    return own.select(*keys, "region", "pos", "target", tx.collapse(F.col("text")).alias("text"), F.when(F.col("region") < 5, "nav-link").otherwise("footer-link").alias("via"))


def primary_type(types: Column) -> Column:
    """The first type that says something, else the first, else unknown."""
    return F.coalesce(F.get(F.filter(types, lambda t: ~t.isin("unknown", "homepage")), 0), F.get(types, 0), F.lit("unknown"))


def candidates_per_type(links: DataFrame, keys: list[str], k: int = 2) -> DataFrame:
    """Up to k links of each page type, addresses once each: links has (keys, ord, target, types)."""
    rows = links.withColumn("page_type", F.explode("types")).withColumn("canon", urls.canonical(F.col("target")))
    return top(keep_first(rows, [*keys, "page_type", "canon"], ["ord"]), [*keys, "page_type"], ["ord"], k, "place")


def budget(candidates: DataFrame, keys: list[str], limit: int = 8, priority: list[str] = PRIORITY) -> DataFrame:
    """The pages to read besides the homepage: types in their order, each address once with all its types."""
    rank = F.array_position(F.array(*[F.lit(p) for p in priority]), F.col("page_type"))
    ranked = candidates.withColumn("prio", F.when(rank == 0, len(priority) + 1).otherwise(rank))
    typed = ranked.groupBy(*keys, "canon").agg(F.min(F.struct("prio", "ord")).alias("best"), F.array_sort(F.collect_set(F.struct("prio", "page_type"))).alias("t"))
    return top(typed.select(*keys, "canon", "best", F.transform("t", lambda t: t["page_type"]).alias("page_types")), keys, ["best", "canon"], limit, "place").drop("best")


def failure(status: Column, code: Column) -> Column:
    """Why a fetch failed, from its HTTP status or error code; null for success."""
    c = F.upper(F.coalesce(code, F.lit("")))
    return (
        F.when(c.rlike("ABORT|TIMEDOUT|TIMEOUT"), "timeout").when(c.isin("ENOTFOUND", "EAI_AGAIN"), "dns").when(c.isin("ECONNREFUSED", "ECONNRESET"), "connection-refused")
        .when(c.rlike("CERT"), "blocked").when(c != "", "unknown").when(status.isin(401, 403, 429), "blocked").when(~status.between(200, 299), "http-error")
    )


def soft_404(body: Column, home: Column) -> Column:
    """Whether a page that answers is a stand-in for a missing one: empty, the homepage again, nearly its size with its title, or titled so."""

    def title(x: Column) -> Column:
        return F.nullif(tx.collapse(F.regexp_extract(x, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))

    near = F.abs(F.length(body) - F.length(home)) <= 0.02 * F.greatest(F.length(home), F.lit(1))
    return F.coalesce(
        (F.length(F.trim(body)) == 0) | (body == home) | (near & title(body).eqNullSafe(title(home))) | F.coalesce(title(body).rlike(r"(?i)\b404\b|not found|unavailable|doesn.t exist"), F.lit(False)), F.lit(True)
    )


def scan_status(failures: DataFrame, keys: list[str], resumed: str = "resumed") -> DataFrame:
    """(keys, status): partial after any time-out of a fresh scan, or any failure of a resumed one."""
    bad = (F.col("reason") == "timeout") | (F.col(resumed) & F.col("reason").isNotNull())
    return failures.groupBy(*keys).agg(F.when(F.bool_or(F.coalesce(bad, F.lit(False))), "partial").otherwise("complete").alias("status"))


def unread(planned: DataFrame, read: DataFrame, keys: list[str]) -> DataFrame:
    """Planned pages that were not read."""
    return planned.join(read, keys, "left_anti")


def warnings(scans: DataFrame) -> Column:
    """What a reviewer should know of a scan, in a fixed order."""
    c = F.col
    return F.array_compact(
        F.array(
            F.when(c("status") == "partial", "partial"), F.when(c("year_conflict"), "year-conflict"), F.when(c("nav_unusable"), "nav-unusable"),
            F.when(c("sitemap_types") > 0, "sitemap-fallback"), F.when(c("probed_types") > 0, "probed"), F.when(c("unmatched_types") > 0, "unmatched"), F.when(c("pages") == 1, "one-page"),
        )
    )


def to_probe(pages: DataFrame, keys: list[str], probed: list[str], types: list[str]) -> DataFrame:
    """(keys, missing): the types that can be probed for among those of which a site has no page."""
    seen = pages.groupBy(*keys).agg(F.collect_set("page_type").alias("seen"))  # at most all types
    unmatched = F.array_except(F.array(*[F.lit(t) for t in types]), F.col("seen"))
    return seen.select(*keys, F.array_intersect(F.array(*[F.lit(t) for t in probed]), unmatched).alias("missing"))
