"""What a site's structured data says of its owner, over all of its pages.

Nodes are rows (site keys, ord, pos, types, node) in crawl order.  The owner's
node is the first with a type of `ORG_TYPES`; only where a site has none, the
first whose type ends like a business's (`ORG_PATTERN`).  Both passes are one
aggregation: the least (rank, ord, pos) of each site.  A field that the node
doesn't state is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .profile import DBA, GENERAL_TYPES, ROLE_TYPES

# The types of an owner's node, and how such types end.
ORG_TYPES = [
    "Organization", "LocalBusiness", "Corporation", "ProfessionalService", "Store", "Restaurant", "MedicalBusiness", "HomeAndConstructionBusiness", "LegalService", "FinancialService", "AutomotiveBusiness", "HealthAndBeautyBusiness", "FoodEstablishment",
    "EntertainmentBusiness", "ChildCare", "RealEstateAgent",
]
ORG_PATTERN = r"(?i)(?:Business|Service|Store|Shop|Agency|Organization|Corporation|Company|Practice|Clinic|Restaurant|Hotel|School|Contractor|Dentist|Physician|Plumber|Electrician|Attorney|Realtor)\z"


def _kind(node: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(node, path, "variant"))


def stated(node: Column, path: str) -> Column:
    """A text that isn't blank, or a number as text, at a path of a VARIANT; else null."""
    kind, text = _kind(node, path), F.try_variant_get(node, path, "string")
    return F.when(kind == "STRING", tx.null_if_blank(text)).when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), text)


def texts(node: Column, path: str) -> Column:
    """The texts at a path, which holds one or a list of them; other things are left out."""
    many = F.transform(F.filter(F.try_variant_get(node, path, "array<variant>"), lambda x: F.schema_of_variant(x) == "STRING"), lambda x: F.try_variant_get(x, "$", "string"))
    return F.when(_kind(node, path) == "STRING", F.array(F.try_variant_get(node, path, "string"))).otherwise(F.coalesce(many, F.array().cast("array<string>")))


def in_words(kind: Column) -> Column:
    """A type's name in words: AccountingService as Accounting Service."""
    return tx.collapse(F.regexp_replace(kind, "([a-z0-9])([A-Z])", "$1 $2"))


def site_nodes(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, org, trail): the owner's node and the first list of breadcrumbs of each site, as VARIANT; null where there is none."""
    low = F.transform("types", F.lower)
    listed = F.arrays_overlap(low, F.array(*[F.lit(t.lower()) for t in ORG_TYPES]))
    rank = F.when(listed, 0).when(F.exists("types", lambda t: t.rlike(ORG_PATTERN)), 1)
    trail = F.when(F.array_contains(low, "breadcrumblist"), F.struct("ord", "pos"))
    best = nodes.groupBy(*keys).agg(F.min_by("node", F.when(rank.isNotNull(), F.struct(rank, "ord", "pos"))).alias("org"), F.min_by("node", trail).alias("trail"))
    return best.select(*keys, F.try_parse_json("org").alias("org"), F.try_parse_json("trail").alias("trail"))


def crumbs(trail: Column) -> Column:
    """The names of a list of breadcrumbs, in its order: each item's own, or that of what it points to."""
    named = lambda x: F.coalesce(tx.collapse(F.when(_kind(x, "$.name") == "STRING", F.try_variant_get(x, "$.name", "string"))), tx.collapse(F.when(_kind(x, "$.item.name") == "STRING", F.try_variant_get(x, "$.item.name", "string"))))
    return F.filter(F.transform(F.try_variant_get(trail, "$.itemListElement", "array<variant>"), named), lambda x: F.length(x) > 0)


def organizations(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, name, legal, alternates, types, industry, founded, staff, trail) as each site's owner's node states them."""
    o, kinds = F.col("org"), texts(F.col("org"), "$['@type']")
    more = F.when(_kind(F.col("org"), "$.additionalType") == "STRING", tx.null_if_blank(F.try_variant_get(o, "$.additionalType", "string")))
    specific = F.get(F.filter(kinds, lambda t: ~t.isin(GENERAL_TYPES)), 0)
    staff = F.coalesce(stated(o, "$.numberOfEmployees"), F.when(_kind(o, "$.numberOfEmployees").startswith("OBJECT"), stated(o, "$.numberOfEmployees.value")))
    year = F.regexp_extract(F.coalesce(stated(o, "$.foundingDate"), F.lit("")), r"((?:18|19|20)\d{2})", 1)
    return site_nodes(nodes, keys).select(
        *keys, stated(o, "$.name").alias("name"), stated(o, "$.legalName").alias("legal"), F.transform(texts(o, "$.alternateName"), tx.collapse).alias("alternates"), kinds.alias("types"),
        F.coalesce(stated(o, "$.industry"), stated(o, "$.knowsAbout"), in_words(F.element_at(F.split(more, "/"), -1)), in_words(specific)).alias("industry"),
        F.when(year != "", year.cast("int")).alias("founded"), staff.alias("staff"), crumbs(F.col("trail")).alias("trail"),
    )


def role_of(types: Column) -> Column:
    """The role that any of a node's types says; roles are tried in their order."""
    any_like = lambda pattern: F.exists(types, lambda t: t.rlike(pattern))
    return F.coalesce(*[F.when(any_like(p), F.lit(label)) for label, p in ROLE_TYPES])


def names(orgs: DataFrame, home: DataFrame, dba: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, name, alternatives): the owner's name (its own, its legal one, the homepage's site name, then its title), and its other names, once each.

    orgs is that of `organizations`, home has (keys, og_name, title) of the homepage, dba (keys, dba).
    """
    from .profile import title_name

    og = tx.null_if_blank(F.col("og_name"))
    rows = home.join(orgs, keys, "left").join(dba, keys, "left")
    own = F.coalesce("name", "legal", og, title_name(F.col("title")))
    others = F.array_distinct(F.filter(F.concat(F.coalesce("alternates", F.array().cast("array<string>")), F.array("legal", og, "dba")), lambda x: F.length(x) > 0))
    return rows.select(*keys, own.alias("name"), F.filter(others, lambda x: F.lower(x) != F.lower(F.coalesce(own, F.lit("")))).alias("alternatives"))


def doing_business_as(texts_: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """(keys, dba): the first "doing business as" of a site's texts."""
    said = tx.null_if_blank(F.regexp_extract("text", tx.edges(DBA), 1))
    return texts_.groupBy(*keys).agg(F.min(F.when(said.isNotNull(), F.struct(*order, said.alias("v"))))["v"].alias("dba"))


def industry(orgs: DataFrame, offers: DataFrame, home: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, industry): as structured data says, else the offers' common category (keys, category), else the homepage's keywords if they are few, else the first crumb below the root of a short trail."""
    words = F.filter(F.transform(F.split("keywords", ","), tx.collapse), lambda w: F.length(w).between(3, 40))
    keyword = F.when(F.size(words).between(1, 8), words[0])
    below = F.get(F.filter("trail", lambda x: ~x.rlike(r"(?i)^(home|homepage|start)\z")), 0)
    crumb = F.when(F.size("trail").between(2, 4) & F.length(below).between(3, 40), below)
    rows = home.join(orgs, keys, "left").join(offers.select(*keys, "category"), keys, "left")
    return rows.select(*keys, F.coalesce("industry", "category", keyword, crumb).alias("industry"))
