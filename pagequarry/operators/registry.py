"""The profile's fields as data, and what is derived from them: completeness, pruning, problems, review state.

A field is a row (path, grp, category, kind, required, sub_fields).  Plans are
generated from it, so that a field more is a row more.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Field(NamedTuple):
    path: str
    grp: str
    category: int
    kind: str
    required: bool = False
    sub_fields: tuple[str, ...] = ()


# The profile's fields, in order.
FIELDS = [
    Field("companyFoundation.overview", "foundation", 2, "longText", True),
    Field("companyFoundation.companyName", "foundation", 1, "text"),
    Field("companyFoundation.website", "foundation", 1, "url"),
    Field("companyFoundation.industry", "foundation", 1, "text"),
    Field("companyFoundation.businessModel", "foundation", 1, "text"),
    Field("companyFoundation.companyRole", "foundation", 1, "text"),
    Field("companyFoundation.yearFounded", "foundation", 1, "number"),
    Field("companyFoundation.legalEntityType", "foundation", 1, "text"),
    Field("companyFoundation.employeeCount", "foundation", 1, "text"),
    Field("companyFoundation.mainAddress", "foundation", 1, "text"),
    Field("companyFoundation.otherLocations", "foundation", 3, "objectList", False, ("label", "address")),
    Field("companyFoundation.serviceLocations", "foundation", 3, "stringList"),
    Field("companyFoundation.alternativeCompanyNames", "foundation", 3, "stringList"),
    Field("positioning.pitch", "positioning", 2, "longText", True),
    Field("positioning.foundingStory", "positioning", 2, "longText"),
    Field("marketAndCustomers.targetBuyers", "market", 2, "longText"),
    Field("marketAndCustomers.customerNeeds", "market", 2, "longText"),
    Field("marketAndCustomers.idealCustomerPersona", "market", 2, "longText"),
    Field("marketAndCustomers.industryGroupings", "market", 3, "stringList"),
    Field("marketAndCustomers.industryOutlook", "market", 2, "longText"),
    Field("marketAndCustomers.channels", "market", 3, "stringList"),
    Field("marketAndCustomers.funnels", "market", 3, "stringList"),
    Field("marketAndCustomers.ctas", "market", 3, "objectList", False, ("label", "href", "kind")),
    Field("marketAndCustomers.suppliersPartners", "market", 3, "objectList", False, ("name", "domain", "detectedVia")),
    Field("brandingAndStyle.writingStyle", "branding", 2, "longText"),
    Field("brandingAndStyle.artStyle", "branding", 2, "longText"),
    Field("brandingAndStyle.fonts", "branding", 1, "stringList"),
    Field("brandingAndStyle.brandColors", "branding", 1, "stringList"),
    Field("brandingAndStyle.logos", "branding", 3, "objectList", False, ("url", "alt", "detectedVia")),
    Field("onlinePresence.socialMediaLinks", "presence", 3, "objectList", False, ("platform", "url")),
    Field("keyPeople", "people", 3, "objectList", False, ("name", "title", "bio", "gender", "credentials")),
    Field("offerings", "offerings", 3, "objectList", True, ("name", "description", "features", "price", "category")),
    Field("extensions.siteLanguage", "extensions", 1, "language"),
    Field("extensions.demographicDetail", "extensions", 1, "structured"),
    Field("extensions.valuesAndSocialPositioning", "extensions", 2, "longText"),
    Field("extensions.testimonials", "extensions", 3, "objectList", False, ("quote", "attributedTo")),
    Field("extensions.faq", "extensions", 3, "objectList", False, ("question", "answer")),
    Field("extensions.differentiators", "extensions", 2, "longText"),
    Field("extensions.certifications", "extensions", 3, "objectList", False, ("name", "issuer", "year")),
    Field("extensions.contentThemes", "extensions", 3, "objectList", False, ("theme", "mentions", "examples")),
    Field("extensions.legalAndCompliance", "extensions", 3, "objectList", False, ("kind", "text")),
    Field("extensions.currentPromotions", "extensions", 2, "longText"),
]
MOCK = "[MOCK"


def frame(spark: SparkSession) -> DataFrame:
    rows = [(f.path, f.grp, f.category, f.kind, f.required, list(f.sub_fields), i) for i, f in enumerate(FIELDS)]
    return spark.createDataFrame(rows, "path string, grp string, category int, kind string, required boolean, sub_fields array<string>, ord int")


def has_content(x: Column, kind: str) -> Column:
    """Whether a value counts: visible text, a number but 0, true, a list with such a value; false for null."""
    if kind == "stringList":
        return F.coalesce(F.exists(x, lambda v: F.length(F.trim(v)) > 0), F.lit(False))
    if kind == "number":
        return x.isNotNull()
    if kind == "flag":
        return F.coalesce(x, F.lit(False))
    return F.coalesce(F.length(F.trim(x.cast("string"))) > 0, F.lit(False))


def entry_has_content(entry: Column, sub_fields: tuple[str, ...]) -> Column:
    """Whether one of an entry's registered sub-fields counts; an entry without registered sub-fields does."""
    tests = [has_content(entry[s], "text") for s in sub_fields]
    return F.coalesce(F.reduce(F.array(*tests), F.lit(False), lambda a, b: a | b), F.lit(False)) if tests else F.lit(True)


def populated(x: Column, field: Field) -> Column:
    """Whether a field counts as filled: evidence by its status, lists by their content."""
    if field.category == 2:
        return F.coalesce(x["status"] == "found", F.lit(False))
    if field.kind == "objectList":
        return F.coalesce(F.exists(x, lambda e: entry_has_content(e, field.sub_fields)), F.lit(False))
    if field.kind == "language":
        return F.coalesce((F.length(x["main"]) > 0) | (F.size(x["alternates"]) > 0), F.lit(False))
    return has_content(x, field.kind)


def completeness(docs: DataFrame, fields: list[Field], keys: list[str], hidden: str = "hidden") -> DataFrame:
    """(keys, score, populated, counted, hidden_count, missing): hidden names a column with the hidden groups; missing has (path, reason, required) in the fields' order."""
    is_hidden = [F.array_contains(F.coalesce(F.col(hidden), F.array().cast("array<string>")), f.grp) for f in fields]
    filled = [populated(F.col(f.path), f) for f in fields]
    states = F.array(*[F.struct(F.lit(f.path).alias("path"), h.alias("hidden"), p.alias("filled"), F.lit(f.required).alias("required")) for f, h, p in zip(fields, is_hidden, filled, strict=True)])
    out = docs.select(*keys, states.alias("s"))
    counted, done = F.size(F.filter("s", lambda s: ~s["hidden"])), F.size(F.filter("s", lambda s: ~s["hidden"] & s["filled"]))
    score = F.when(counted == 0, 0).otherwise(F.floor(100 * done / counted + 0.5)).cast("long")
    missing = F.transform(F.filter("s", lambda s: s["hidden"] | ~s["filled"]), lambda s: F.struct(s["path"].alias("path"), F.when(s["hidden"], "hidden").otherwise("not-found").alias("reason"), s["required"].alias("required")))
    return out.select(*keys, score.alias("score"), done.cast("long").alias("populated"), counted.cast("long").alias("counted"), (F.size("s") - counted).cast("long").alias("hidden_count"), missing.alias("missing"))


def _keeps(field: Field) -> Callable[[Column], Column]:
    if field.kind == "objectList":
        return lambda e: entry_has_content(e, field.sub_fields)
    return lambda e: F.length(F.trim(e)) > 0


def prune(docs: DataFrame, fields: list[Field]) -> DataFrame:
    """Lists without their empty entries; texts of string lists trimmed. Adds pruned: how many entries went, by path."""
    lists = [f for f in fields if f.kind in ("objectList", "stringList")]
    if not lists:
        return docs
    size = lambda x: F.size(F.coalesce(x, F.array()))
    gone = F.array(*[F.struct(F.lit(f.path).alias("path"), (size(F.col(f.path)) - size(F.filter(f.path, _keeps(f)))).cast("long").alias("removed")) for f in lists])
    out = docs.withColumn("pruned", F.filter(gone, lambda g: g["removed"] > 0))
    for f in lists:
        kept = F.filter(f.path, _keeps(f))
        kept = kept if f.kind == "objectList" else F.transform(kept, lambda v: F.trim(v))
        head, _, tail = f.path.partition(".")
        out = out.withColumn(head, F.col(head).withField(tail, kept) if tail else kept)
    return out


def is_reviewed(value: Column, placeholder: Column) -> Column:
    """Whether a reviewer has dealt with a text: not while it is the placeholder, another mock text, or was empty from the start."""
    v, p = F.trim(F.coalesce(value, F.lit(""))), F.trim(F.coalesce(placeholder, F.lit("")))
    return F.when(v == p, False).when(v.startswith(MOCK), False).otherwise(True)


def placeholder(label: Column, status: Column, count: Column) -> Column:
    """The text that stands in for a field with evidence until somebody writes it."""
    return F.when(status == "found", F.concat(F.lit(MOCK + " "), label, F.lit(": from "), count.cast("string"), F.when(count == 1, " snippet]").otherwise(" snippets]"))).otherwise("")


def resolve_text(value: Column, reviewed: Column, status: Column) -> Column:
    """What becomes of a reviewed text: its problem, or null if it can be saved."""
    v = F.trim(F.coalesce(value, F.lit("")))
    return F.when((v == "") & (status != "found"), "absent-and-empty").when(v == "", "empty").when(~reviewed, "unreviewed").when(v.startswith(MOCK), "mock-text")


def persona_fit(testimonials: Column, persona: Column) -> tuple[Column, Column]:
    """How well testimonials and persona can be compared: alignment and confidence."""
    poor = (testimonials == 0) | (F.length(F.trim(F.coalesce(persona, F.lit("")))) == 0)
    return F.when(poor, "insufficient_data").otherwise("partial"), F.when(poor, "high").otherwise("low")
