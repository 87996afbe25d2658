"""Resolvers of a profile's fields over all pages of a site.

Pages are rows (site keys, ord, page_type, text, ...), one for each page in crawl
order, and stay rows: what a site's pages say together comes from aggregates
with an explicit order (`min_by` over (tier, ord)), never from their texts put
into one, so a site with very many pages is no wider than others.  A field that
no tier gives is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .order import bundle, keep_first, round_robin, top
from .resolve import evidence

# Vendors by what they stand for, and patterns of statements.
COMMERCE = ["Shopify", "Square", "Toast", "DoorDash", "PayPal", "Stripe"]
SHOPS = ["Shopify", "Square", "Toast", "Etsy"]
BOOKING = ["Calendly", "Acuity Scheduling", "Mindbody", "OpenTable", "Resy"]
NEWSLETTER, CHAT = ["Mailchimp", "Klaviyo"], ["Intercom", "Zendesk", "Tawk.to", "Podium"]
STAFF = [r"(?i)\bteam of (?:over |more than |nearly |about )?(\d{1,5})\b", r"(?i)\b(\d{1,5})[+\s-]*(?:employees|staff members|team members|technicians|professionals)\b"]
LEGAL_NAME = r"\b[A-Z][\w&.'-]*(?:[\s-]+[A-Z][\w&.'-]*){0,5},?\s+(LLC|L\.L\.C\.|Inc\.?|Incorporated|Corp\.?|Corporation|Ltd\.?|Limited|LLP|LP|PLLC|P\.C\.|GmbH|Pty Ltd)\b"
#: one of which stands in all that `DBA` finds
DBA_PHRASES = ["dba", "d/ba", "db/a", "d/b/a", "doing business as"]
DBA = r"(?i)\b(?:d/?b/?a|doing business as)\s+([A-Z][\w&.,' -]{2,60})"
ROLE_TYPES = [("Retailer", r"(?i)Store|Retail|ShoppingCenter"), ("Food service operator", r"(?i)Restaurant|FoodEstablishment|Bakery|Cafe"), ("Service provider", r"(?i)Service|Contractor|Agent|Practice|Clinic"), ("Manufacturer", r"(?i)Manufacturer|Factory")]
GENERAL_TYPES = ["Organization", "LocalBusiness", "Corporation"]
IMAGE_RANK = ["og:image", "img[logo]", "header img", "link[apple-touch-icon]", "link[rel=icon]"]


def _flag(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def context(pages: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, homepage, n_pages): the first page typed homepage, else the first page."""
    return pages.groupBy(*keys).agg(F.min(F.struct(F.col("page_type") != "homepage", "ord"))["ord"].alias("homepage"), F.count("*").alias("n_pages"))


def first_stated(pages: DataFrame, keys: list[str], value: str, alias: str) -> DataFrame:
    """(keys, alias): the first page's value that isn't blank."""
    v = tx.null_if_blank(F.col(value))
    return pages.groupBy(*keys).agg(F.min(F.when(v.isNotNull(), F.struct("ord", v.alias("v"))))["v"].alias(alias))


def home_values(pages: DataFrame, keys: list[str], *columns: str) -> DataFrame:
    """(keys, columns) of the homepage."""
    at = F.struct(F.col("page_type") != "homepage", "ord")
    return pages.groupBy(*keys).agg(*[F.min_by(c, at).alias(c) for c in columns])


def title_name(title: Column) -> Column:
    """The first segment of a page's title, if it is short enough for a name."""
    first = tx.collapse(F.split(title, r"[|–—·-]")[0])
    return F.when(F.length(first) <= 60, tx.null_if_blank(first))


def company_name(pages: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, name): structured name, structured legal name, the homepage's site name, then its title."""
    stated = first_stated(pages, keys, "json_name", "a").join(first_stated(pages, keys, "json_legal", "b"), keys)
    home = home_values(pages, keys, "og_name", "title")
    return stated.join(home, keys).select(*keys, F.coalesce("a", "b", tx.null_if_blank(F.col("og_name")), title_name(F.col("title"))).alias("name"))


def alternative_names(pages: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, place, name): legal name, site name and "doing business as", without the company's own name."""
    dba = pages.withColumn("dba", F.nullif(F.regexp_extract("text", tx.edges(DBA), 1), F.lit("")))
    all_ = first_stated(pages, keys, "json_legal", "b").join(home_values(pages, keys, "og_name"), keys).join(first_stated(dba, keys, "dba", "d"), keys).join(company_name(pages, keys), keys)
    names = F.array_distinct(F.array_compact(F.array("b", tx.null_if_blank(F.col("og_name")), "d")))
    rest = F.filter(names, lambda n: F.lower(n) != F.lower(F.coalesce("name", F.lit(""))))
    return all_.select(*keys, F.posexplode(rest).alias("place", "name")).withColumn("place", F.col("place").cast("long") + 1)


def industry_of(pages: DataFrame, offers: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, industry): structured industry, a specific structured type in words, the offers' mode (keys, industry), then keywords."""
    stated = first_stated(pages, keys, "json_industry", "a")
    specific = pages.withColumn("t", F.when(~F.col("json_type").isin(GENERAL_TYPES), F.trim(F.regexp_replace("json_type", "([a-z])([A-Z])", "$1 $2"))))
    words = F.filter(F.transform(F.split("keywords", ","), lambda w: F.trim(w)), lambda w: F.length(w).between(3, 40))
    fit = pages.withColumn("k", F.when(F.size(words).between(1, 8), words[0]))
    found = stated.join(first_stated(specific, keys, "t", "b"), keys).join(offers.select(*keys, F.col("industry").alias("c")), keys, "left").join(first_stated(fit, keys, "k", "d"), keys)
    return found.select(*keys, F.coalesce("a", "b", "c", "d").alias("industry"))


def company_role(rows: DataFrame, kinds: DataFrame, keys: list[str], roles: dict[str, list[str]], audiences: dict[str, list[str]]) -> DataFrame:
    """(keys, role): what the type of the owner's node says (keys, typed), else the first role that any text states, with its audiences before it, else what a shop system shows; rows have (keys, text, vendor)."""
    flags = {("r", k): tx.any_phrase(F.col("text"), p) for k, p in roles.items()} | {("a", k): tx.any_phrase(F.col("text"), p) for k, p in audiences.items()} | {("s", "shop"): F.col("vendor").isin(SHOPS)}
    seen = rows.groupBy(*keys).agg(*[F.bool_or(_flag(f)).alias(f"f{i}") for i, f in enumerate(flags.values())])
    named = lambda kind: F.array_compact(F.array(*[F.when(F.col(f"f{i}"), F.lit(k)) for i, (g, k) in enumerate(flags) if g == kind]))
    spoken = F.when(F.size(named("r")) > 0, F.concat_ws(" ", F.nullif(F.array_join(named("a"), " and "), F.lit("")), F.get(named("r"), 0)))
    return seen.join(kinds, keys, "left").select(*keys, F.coalesce("typed", spoken, F.when(F.size(named("s")) > 0, "Retailer")).alias("role"))


def legal_entity(pages: DataFrame, keys: list[str], suffixes: list[str]) -> DataFrame:
    """(keys, entity): a legal suffix among the words of the company's name, of its alternative names, or of a legal name in prose."""

    def suffix(name: Column) -> Column:
        words = F.transform(F.split(F.regexp_replace(name, ",", " "), r"\s+"), lambda w: F.lower(F.replace(w, F.lit("."), F.lit(""))))
        return F.coalesce(*[F.when(F.array_contains(words, s.lower().replace(".", "")), F.lit(s)) for s in suffixes])

    own = company_name(pages, keys).select(*keys, suffix(F.col("name")).alias("a"))
    other = alternative_names(pages, keys).withColumn("s", suffix(F.col("name")))
    other = other.groupBy(*keys).agg(F.min(F.when(F.col("s").isNotNull(), F.struct("place", "s")))["s"].alias("b"))
    prose = first_stated(pages.withColumn("p", F.nullif(F.regexp_extract("text", tx.edges(LEGAL_NAME), 1), F.lit(""))), keys, "p", "c")
    return own.join(other, keys, "left").join(prose, keys).select(*keys, F.coalesce("a", "b", "c").alias("entity"))


def employees(pages: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, employees): the structured number, else the first page's statement by the first pattern, else by the second."""
    hits = [F.nullif(F.regexp_extract("text", tx.edges(p), 0), F.lit("")) for p in STAFF]
    rows = pages.withColumns({"p0": hits[0], "p1": hits[1]})
    found = first_stated(rows, keys, "json_staff", "a").join(first_stated(rows, keys, "p0", "b"), keys).join(first_stated(rows, keys, "p1", "c"), keys)
    return found.select(*keys, F.coalesce("a", "b", "c").alias("employees"))


def preferred_first(rows: DataFrame, keys: list[str], types: list[str], dedupe: Column, k: int) -> DataFrame:
    """(…, place): the first k rows with different values, those of pages of the preferred types first, type by type, the rest in crawl order."""
    rank = F.array_position(F.array(*[F.lit(t) for t in types]), F.col("page_type"))
    ranked = rows.withColumns({"__tier": F.when(rank == 0, len(types) + 1).otherwise(rank), "__same": dedupe})
    kept = keep_first(ranked, [*keys, "__same"], ["__tier", "ord"])
    return top(kept, keys, ["__tier", "ord"], k, "place").drop("__tier", "__same")


def addresses(pages: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, place, address, main): the main address, contact pages first, and up to eight others."""
    rows = preferred_first(pages.filter(F.length(F.trim("address")) > 0), keys, ["contact"], F.col("address"), 9)
    return rows.select(*keys, "place", "address", (F.col("place") == 1).alias("main"))


def service_areas(pages: DataFrame, keys: list[str], phrases: list[str], k: int = 8) -> DataFrame:
    """(keys, place, sentence): the sentences of 13 to 219 characters that tell where a company works."""
    said = pages.select(*keys, "ord", F.posexplode(tx.sentences(F.col("text"))).alias("pos", "s")).withColumn("sentence", tx.collapse(F.col("s")))
    said = said.filter(F.length("sentence").between(13, 219) & tx.any_phrase(F.col("sentence"), phrases))
    return top(keep_first(said, [*keys, "sentence"], ["ord", "pos"]), keys, ["ord", "pos"], k, "place").select(*keys, "place", "sentence")


def phrase_fields(pages: DataFrame, keys: list[str], lists: dict[str, list[str]], k: int = 3) -> DataFrame:
    """(keys, a field for each list): the first k phrases that any page states, in the list's order, joined; each field by itself."""
    names = [(f, i, p) for f, phrases in lists.items() for i, p in enumerate(phrases)]
    low = F.lower("text")
    agg = pages.groupBy(*keys).agg(*[F.bool_or(_flag(F.contains(low, F.lit(p.lower())))).alias(f"{f}_{i}") for f, i, p in names])
    joined = {f: F.array_join(F.slice(F.array_compact(F.array(*[F.when(F.col(f"{f}_{i}"), F.lit(p)) for g, i, p in names if g == f])), 1, k), ", ") for f in lists}
    return agg.select(*keys, *[F.nullif(v, F.lit("")).alias(f) for f, v in joined.items()])


def signal_bundle(snippets: DataFrame, keys: list[str], signals: list[str] | None, order: list[str], k: int = 6, spread: bool = True) -> DataFrame:
    """(keys, place, text): snippets (keys, source, order, text) with a signal, in turns from their sources, blanks and near repeats left out."""
    met = snippets if signals is None else snippets.filter(tx.any_phrase(F.col("text"), signals))
    if spread:
        met, order = round_robin(met, keys, "source", order, k), ["place"]
    return bundle(met, keys, "text", order, k).select(*keys, "place", "text")


def tiers(keys: list[str], *parts: DataFrame) -> DataFrame:
    """Snippets of several origins as one table; those of the first come first: (keys, source, tier, ord, pos, text)."""
    out = None
    for i, p in enumerate(parts):
        p = p.select(*keys, "source", F.lit(i).alias("tier"), "ord", "pos", "text")
        out = p if out is None else out.unionByName(p)
    return out


def discounts(offers: DataFrame, keys: list[str], k: int = 6) -> DataFrame:
    """(keys, source, ord, pos, text): prices that were lowered, said in a sentence."""
    shown = offers.filter(F.col("was").isNotNull() & F.col("now").isNotNull() & (F.col("was") != F.col("now")))
    said = shown.withColumn("text", F.concat(F.coalesce("name", F.lit("This product")), F.lit(": was "), "was", F.lit(", now "), "now", F.lit(".")))
    kept = keep_first(said.withColumn("__low", F.lower("text")), [*keys, "__low"], ["ord", "pos"])
    return top(kept, keys, ["ord", "pos"], k).select(*keys, "source", "ord", "pos", "text")


def site_channels(pages: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, labels): the ways in which a site can be reached, in their fixed order."""
    kind, v = F.col("cta_kind"), F.col("vendor")
    return evidence(pages, keys, {
        "Online (website forms)": kind == "form", "Phone": (kind == "tel") | F.col("phone").isNotNull(), "Email": (kind == "mailto") | F.col("email").isNotNull(),
        "Online booking": (kind == "booking") | v.isin(BOOKING), "Online ordering / e-commerce": v.isin(COMMERCE), "Social media": F.col("social").isNotNull(), "In person (physical location)": F.col("address").isNotNull(),
    })


def site_funnels(pages: DataFrame, keys: list[str], labels: dict[str, str]) -> DataFrame:
    """(keys, labels): the mechanisms that bring customers, in their fixed order; labels has the patterns by label."""
    label, kind, text, v = F.col("cta_label"), F.col("cta_kind"), F.col("text"), F.col("vendor")
    says = lambda name, x: _flag(x.rlike(labels[name]))
    by_label = {n: says(n, label) for n in ("Newsletter signup", "Contact form", "Quote / estimate request", "Appointment scheduler", "Demo request", "Free inspection or assessment")}
    form = _flag((kind == "form") & label.rlike("(?i)contact|message|enquir|inquir|get in touch"))
    return evidence(pages, keys, {
        "Newsletter signup": by_label["Newsletter signup"] | _flag(v.isin(NEWSLETTER)), "Contact form": by_label["Contact form"] | form, "Quote / estimate request": by_label["Quote / estimate request"],
        "Appointment scheduler": by_label["Appointment scheduler"] | _flag(v.isin(BOOKING)), "Demo request": by_label["Demo request"], "Content marketing (blog)": F.col("page_type") == "blog",
        "Educational content (FAQs)": (F.col("page_type") == "faq") | (F.col("n_faq") >= 3), "Testimonials and social proof": F.col("quote").isNotNull(), "Financing options": says("Financing options", text),
        "Partnership / reseller program": says("Partnership / reseller program", text), "Free inspection or assessment": by_label["Free inspection or assessment"] | _flag(label.rlike(r"(?i)\bfree analysis\b")) | says("Free inspection or assessment", text), "Live chat": v.isin(CHAT),
    })


def site_ctas(pages: DataFrame, keys: list[str], k: int = 30) -> DataFrame:
    """(keys, place, kind, label, href): the pages' calls to action with where they lead, then phones and mail addresses as such, once each."""
    own = pages.filter("cta_kind IS NOT NULL").select(*keys, F.lit(0).alias("tier"), "ord", F.lit(0).alias("pos"), F.col("cta_kind").alias("kind"), F.col("cta_label").alias("label"), F.col("cta_href").alias("href"))
    tel = pages.filter("phone IS NOT NULL").select(*keys, F.lit(1).alias("tier"), "ord", F.lit(0).alias("pos"), F.lit("tel").alias("kind"), F.col("phone").alias("label"), F.concat(F.lit("tel:"), F.regexp_replace("phone", r"[^\d+]", "")).alias("href"))
    mail = pages.filter("email IS NOT NULL").select(*keys, F.lit(1).alias("tier"), "ord", F.lit(1).alias("pos"), F.lit("mailto").alias("kind"), F.col("email").alias("label"), F.concat(F.lit("mailto:"), "email").alias("href"))
    rows = own.unionByName(tel).unionByName(mail).withColumn("__same", F.concat_ws("::", "kind", F.lower(F.coalesce("label", F.lit("")))))
    return top(keep_first(rows, [*keys, "__same"], ["tier", "ord", "pos"]), keys, ["tier", "ord", "pos"], k, "place").select(*keys, "place", "kind", "label", "href")


def art_style(logos: DataFrame, previews: DataFrame, keys: list[str], k: int = 4) -> DataFrame:
    """(keys, place, url, alt, via): the best k images of logos (keys, ord, url, alt, via), with the last page's preview text (keys, ord, url, alt) where there is one."""
    alts = previews.filter(F.length(F.trim("alt")) > 0).groupBy(*keys, "url").agg(tx.collapse(F.max_by("alt", "ord")).alias("preview"))
    rank = F.array_position(F.array(*[F.lit(r) for r in IMAGE_RANK]), F.col("via"))
    once = keep_first(logos.filter(F.length(F.trim("url")) > 0), [*keys, "url"], ["ord"]).withColumn("rank", F.when(rank == 0, 99).otherwise(rank))
    named = once.join(alts, [*keys, "url"], "left").withColumn("alt", F.coalesce("preview", F.nullif(F.trim("alt"), F.lit(""))))
    return top(named, keys, ["rank", "ord"], k, "place").select(*keys, "place", "url", "alt", "via")


def writing_style(snippets: DataFrame, keys: list[str], k: int = 6) -> DataFrame:
    """(keys, place, text): prose of 40 characters or more (any prose where there is none), declared text, headings, and names only without prose, a tier in turn; snippets has kind prose, declared, heading or name."""
    has = snippets.groupBy(*keys).agg(F.bool_or((F.col("kind") == "prose") & (F.length("text") >= 40)).alias("long"), F.bool_or(F.col("kind") == "prose").alias("any"))
    fit = snippets.join(has, keys).filter(((F.col("kind") == "prose") & (~F.col("long") | (F.length("text") >= 40))) | F.col("kind").isin("declared", "heading") | ((F.col("kind") == "name") & ~F.col("any")))
    tier = F.array_position(F.array(*[F.lit(x) for x in ("prose", "declared", "heading", "name")]), F.col("kind"))
    turns = top(fit.withColumn("tier", tier), [*keys, "tier"], ["ord"], k, "turn")
    cut = top(turns, keys, ["turn", "tier"], k, "place").drop("turn")
    return bundle(cut, keys, "text", ["place"], k).select(*keys, "place", "text")
