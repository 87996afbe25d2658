"""Registered queries of profile fields and drafts, each with the SQL that must give the same rows.

Sites are customers and their orders are pages: what stands on a page is
written by `EVIDENCE`, the same expressions in Spark and in the SQL, and the SQL
then reads the statements out of these texts by itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dictionaries as di
from ..functions import text as tx
from ..functions import urls
from ..operators import discover, dom, drafts, extract, order, profile, registry, resolve, structured
from ..sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
K = ["site"]


def q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def cycle(key: str, values: list[str | None]) -> str:
    """The values in turn by a key; null where there is none."""
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN {q(v)}" for i, v in enumerate(values) if v is not None) + " END"


SENTENCES = [
    "We are a team of over 120 people. Founded on trust.", "Proudly serving Pierce County and beyond. Call us today!", "Our 45 technicians are certified. We help homeowners save money.",
    "Northwind Traders, LLC is a full-service company for b2b clients.", "Summit Works d/b/a Peak Crew, a local shop. The future of the market is growing.", "Financing available on all plans. Free inspection with every order.",
    "Adults and seniors love our affordable luxury condo tours.", "We give back to the community. Locally owned since 1998.", "Why choose us? Unlike other shops we guarantee our work.", "Sale this week: 20% off. Limited time only.",
    "Our clients are small business owners tired of paperwork.", "Plain words with nothing to say about anything at all.", "We manufacture tools and have a partner program. It all started in a shed.",
]
EVIDENCE = {
    "site": "o_custkey", "ord": "o_orderkey", "pos": "0", "page_type": "CASE o_orderpriority WHEN '1-URGENT' THEN 'about' WHEN '2-HIGH' THEN 'contact' WHEN '3-MEDIUM' THEN 'homepage' WHEN '4-NOT SPECIFIED' THEN 'blog' ELSE 'services' END",
    "text": cycle("o_orderkey", SENTENCES),
    "title": "CASE o_orderkey % 4 WHEN 0 THEN 'Firm ' || o_custkey || ' | Home' WHEN 1 THEN 'A very long title that goes on and on until nobody reads it any more at firm ' || o_custkey WHEN 2 THEN 'Shop – Firm ' || o_custkey ELSE '' END",
    "og_name": "CASE WHEN o_orderkey % 6 = 0 THEN 'Firm ' || o_custkey || ' Online' END", "json_name": "CASE WHEN o_orderkey % 17 = 0 THEN ' Firm  ' || o_custkey || ' ' END",
    "json_legal": "CASE WHEN o_orderkey % 11 = 0 THEN 'Firm ' || o_custkey || ' Holdings, Inc.' END", "json_type": cycle("o_orderkey", ["AutoRepairStore", "Bakery", "AccountingService", "Manufacturer", "LocalBusiness", *[None] * 14]),
    "json_staff": "CASE WHEN o_orderkey % 23 = 0 THEN '50-100' END", "json_industry": "CASE WHEN o_orderkey % 29 = 0 THEN 'Tool making' END", "keywords": "CASE WHEN o_orderkey % 7 = 0 THEN 'ab, hand tools, saws' WHEN o_orderkey % 7 = 1 THEN 'a,b,c,d,e,f,g,h,i,j' END",
    "address": "CASE WHEN o_orderkey % 5 = 0 THEN (o_orderkey % 40) || ' Elm Street' END", "phone": "CASE WHEN o_orderkey % 6 = 1 THEN '(555) 01' || (10 + o_orderkey % 90) END", "email": "CASE WHEN o_orderkey % 8 = 3 THEN 'mail' || (o_orderkey % 9) || '@firm.example' END",
    "social": "CASE WHEN o_orderkey % 12 = 5 THEN 'https://x.com/f' END", "vendor": cycle("o_orderkey", ["Shopify", "Calendly", "Intercom", "Mailchimp", "Google Analytics", *[None] * 12]),
    "cta_kind": cycle("o_orderkey", ["form", None, "tel", None, "booking", None, None, "link", None, "mailto", None]), "cta_href": "CASE WHEN o_orderkey % 3 > 0 THEN '/act/' || (o_orderkey % 13) END", "cta_label": cycle("o_orderkey", ["Contact us", "Call now", "Book a table", "Get a quote", "Start your demo", "Subscribe", "Free audit", "Send a message", "FREE ANALYSIS"]),
    "quote": "CASE WHEN o_orderkey % 9 = 0 THEN 'They fixed our roof in a day ' || (o_orderkey % 4) END", "n_faq": "CAST(o_orderkey % 5 AS INT)", "heading": cycle("o_orderkey", ["Spring sale now on", "Our story", "Meet the team"]), "item": cycle("o_orderkey", ["Unlike most shops, we care", "Open on Sunday", "Guaranteed work", "A fair discount"]),
    "was": "CASE WHEN o_orderkey % 10 = 0 THEN '$' || (40 + o_orderkey % 3) || '.00' END", "now": "CASE WHEN o_orderkey % 4 = 0 THEN '$40.00' END", "name": "CASE WHEN o_orderkey % 20 = 0 THEN 'Saw ' || (o_orderkey % 7) END",
}
P = "p AS MATERIALIZED (SELECT " + ", ".join(f"{e} AS {n}" for n, e in EVIDENCE.items()) + " FROM orders)"
TRIMMED = lambda c: f"nullif(trim(regexp_replace({c}, '\\s+', ' ', 'g')), '')"
FIRST = lambda c, a: f"arg_min({c}, ord) FILTER (WHERE {c} IS NOT NULL) AS {a}"
HOME = lambda c: f"arg_min({c}, (page_type <> 'homepage', ord))"
CLEAN = "c AS (SELECT * REPLACE (" + ", ".join(f"{TRIMMED(c)} AS {c}" for c in ("json_name", "json_legal", "json_type", "json_staff", "json_industry")) + ") FROM p)"
HOMES = "h AS (SELECT site, min({'a': page_type <> 'homepage', 'o': ord}).o AS ord FROM p GROUP BY site), hv AS (SELECT p.* FROM p JOIN h ON p.site = h.site AND p.ord = h.ord)"
NAMES = CLEAN + ", " + HOMES + f""", n0 AS (SELECT site, {FIRST('json_name', 'a')}, {FIRST('json_legal', 'b')} FROM c GROUP BY site),
t AS (SELECT site, og_name, {TRIMMED("regexp_split_to_array(title, '[|–—·-]')[1]")} AS title FROM hv),
nm AS (SELECT site, coalesce(a, b, {TRIMMED('og_name')}, CASE WHEN length(title) <= 60 THEN title END) AS name FROM n0 JOIN t USING (site))"""
DBA_SQL = f"arg_min(dba, ord) FILTER (WHERE dba IS NOT NULL) AS d FROM (SELECT site, ord, {TRIMMED(f'regexp_extract(text, {q(profile.DBA)}, 1)')} AS dba FROM p) GROUP BY site"
ALTS = NAMES + f""", db AS (SELECT site, {DBA_SQL}),
al AS (SELECT site, list_filter([b, {TRIMMED('og_name')}, d], lambda x: x IS NOT NULL) AS xs, name FROM n0 JOIN t USING (site) JOIN db USING (site) JOIN nm USING (site)),
ax AS (SELECT site, unnest(xs) AS x, unnest(range(len(xs))) AS i, name FROM al),
an AS (SELECT site, x AS name, row_number() OVER (PARTITION BY site ORDER BY i) AS place FROM (SELECT site, x, min(i) AS i FROM ax WHERE lower(x) <> lower(coalesce(name, '')) GROUP BY site, x))"""


def query(sql: str):
    def add(fn):
        QUERIES[fn.__name__] = fn
        ORACLES[fn.__name__] = sql
        return fn

    return add


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").selectExpr(*[f"{e} AS {n}" for n, e in EVIDENCE.items()])


# ---- a site's pages together, and who the company is


@query(f"WITH {P} SELECT site, min({{'a': page_type <> 'homepage', 'o': ord}}).o AS homepage, count(*) AS n_pages FROM p GROUP BY site")
def site_contexts(spark, sf):
    return profile.context(pages(spark, sf), K)


@query(f"WITH {P}, {NAMES} SELECT site, name FROM nm")
def company_names(spark, sf):
    return profile.company_name(pages(spark, sf), K)


@query("SELECT site, lower(regexp_extract(url, '^([a-zA-Z]+):', 1)) || '://' || site AS website FROM (SELECT regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)), '^www\\.', '') AS site, arg_min(url, page_id) AS url FROM pages GROUP BY 1)")
def company_websites(spark, sf):
    p = table(spark, sf, "pages").select(urls.site(F.col("url")).alias("site"), "page_id", "url")
    return p.groupBy("site").agg(urls.canonical_website(F.min_by("url", "page_id")).alias("website"))


@query(f"WITH {P}, {ALTS} SELECT site, place, name FROM an")
def alternative_names(spark, sf):
    return profile.alternative_names(pages(spark, sf), K)


_SUFFIX = lambda c: "coalesce(" + ", ".join(f"CASE WHEN list_contains(list_transform(regexp_split_to_array(replace({c}, ',', ' '), '\\s+'), lambda w: lower(replace(w, '.', ''))), {q(s.lower().replace('.', ''))}) THEN {q(s)} END" for s in di.LEGAL_SUFFIXES) + ")"


@query(f"""WITH {P}, {ALTS}, sa AS (SELECT site, arg_min(s, place) FILTER (WHERE s IS NOT NULL) AS b FROM (SELECT site, place, {_SUFFIX('name')} AS s FROM an) GROUP BY site),
pr AS (SELECT site, arg_min(s, ord) FILTER (WHERE s <> '') AS c FROM (SELECT site, ord, regexp_extract(text, {q(profile.LEGAL_NAME)}, 1) AS s FROM p) GROUP BY site)
SELECT site, coalesce({_SUFFIX('name')}, b, c) AS entity FROM nm LEFT JOIN sa USING (site) JOIN pr USING (site)""")
def legal_entities(spark, sf):
    return profile.legal_entity(pages(spark, sf), K, di.LEGAL_SUFFIXES)


_HITS = ", ".join(f"{TRIMMED(f'regexp_extract(text, {q(p)}, 0)')} AS s{i}" for i, p in enumerate(profile.STAFF))


@query(f"WITH {P}, {CLEAN}, s AS (SELECT site, ord, json_staff, {_HITS} FROM c) SELECT site, coalesce(arg_min(json_staff, ord) FILTER (WHERE json_staff IS NOT NULL), arg_min(s0, ord) FILTER (WHERE s0 IS NOT NULL), arg_min(s1, ord) FILTER (WHERE s1 IS NOT NULL)) AS employees FROM s GROUP BY site")
def employee_counts(spark, sf):
    return profile.employees(pages(spark, sf), K)


_OFFERS = "o AS (SELECT site, kind, count(*) AS n, min(ord) AS first FROM (SELECT site, ord, " + cycle("ord", ["Tools", "Repairs", "Saws", "Other", None]) + " AS kind FROM p) WHERE kind IS NOT NULL AND kind <> 'Other' GROUP BY site, kind), b AS (SELECT site, kind, n, count(*) OVER (PARTITION BY site) AS kinds, row_number() OVER (PARTITION BY site ORDER BY n DESC, first) AS place FROM o), e AS (SELECT site, kind AS industry FROM b WHERE place = 1 AND (n >= 2 OR kinds = 1))"


@query(f"""WITH {P}, {CLEAN}, {_OFFERS}, w AS (SELECT site, ord, list_transform(string_split(keywords, ','), lambda x: trim(x)) AS ws FROM p), f AS (SELECT site, ord, list_filter(ws, lambda x: length(x) BETWEEN 3 AND 40) AS fit FROM w),
x AS (SELECT site, arg_min(json_industry, ord) FILTER (WHERE json_industry IS NOT NULL) AS a, arg_min(regexp_replace(json_type, '([a-z])([A-Z])', '\\1 \\2', 'g'), ord) FILTER (WHERE json_type IS NOT NULL AND json_type NOT IN ('Organization', 'LocalBusiness', 'Corporation')) AS b FROM c GROUP BY site),
d AS (SELECT site, arg_min(fit[1], ord) FILTER (WHERE len(fit) BETWEEN 1 AND 8) AS d FROM f GROUP BY site) SELECT x.site, coalesce(a, b, industry, d) AS industry FROM x LEFT JOIN e ON x.site = e.site JOIN d ON x.site = d.site""")
def industries(spark, sf):
    p = pages(spark, sf)
    offers = p.select("site", "ord", F.expr(cycle("ord", ["Tools", "Repairs", "Saws", "Other", None])).alias("category")).filter("category IS NOT NULL")
    return profile.industry_of(p, resolve.industry(offers, K, di.GENERIC_CATEGORIES), K)


def q_any(column: str, phrases: list[str]) -> str:
    return f"regexp_matches(lower({column}), {q(tx.alternation([x.lower() for x in phrases]))})"


def q_labels(flags: dict[str, str]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN bool_or(coalesce({c}, false)) THEN {q(k)} END" for k, c in flags.items()) + "], lambda x: x IS NOT NULL)"


@query(f"""WITH {P}, {CLEAN}, k AS (SELECT site, arg_min(json_type, (rank, ord)) AS t FROM (SELECT site, ord, json_type, CASE WHEN json_type = 'LocalBusiness' THEN 0 WHEN json_type IN ('AutoRepairStore', 'AccountingService') THEN 1 END AS rank FROM c) WHERE rank IS NOT NULL GROUP BY site),
r AS (SELECT site, {q_labels({k: q_any('text', v) for k, v in di.ROLES.items()})} AS rs, {q_labels({k: q_any('text', v) for k, v in di.AUDIENCES.items()})} AS au, bool_or(coalesce(vendor IN ('Shopify', 'Square', 'Toast', 'Etsy'), false)) AS shop FROM c GROUP BY site)
SELECT site, coalesce({', '.join(f"CASE WHEN regexp_matches(t, {q(x)}) THEN {q(label)} END" for label, x in profile.ROLE_TYPES)}, CASE WHEN len(rs) > 0 THEN concat_ws(' ', nullif(array_to_string(au, ' and '), ''), rs[1]) END, CASE WHEN shop THEN 'Retailer' END) AS role FROM r LEFT JOIN k USING (site)""")
def company_roles(spark, sf):
    p = pages(spark, sf)
    nodes = p.filter("json_type IS NOT NULL").select("site", "ord", F.lit(0).alias("pos"), F.array("json_type").alias("types"), F.to_json(F.create_map(F.lit("@type"), F.col("json_type"))).alias("node"))
    kinds = structured.organizations(nodes, K).select("site", structured.role_of(F.col("types")).alias("typed"))
    return profile.company_role(p, kinds, K, di.ROLES, di.AUDIENCES)


_TIERED = "SELECT *, row_number() OVER (PARTITION BY site ORDER BY tier, ord) AS place FROM (SELECT *, row_number() OVER (PARTITION BY site, same ORDER BY tier, ord) AS nth FROM ({}) z QUALIFY nth = 1) y"


@query(f"WITH {P} SELECT site, place, address, place = 1 AS main FROM ({_TIERED.format('''SELECT site, ord, address, address AS same, CASE WHEN page_type = 'contact' THEN 1 ELSE 2 END AS tier FROM p WHERE address IS NOT NULL''')}) WHERE place <= 9")
def site_addresses(spark, sf):
    return profile.addresses(pages(spark, sf), K)


@query(f"""WITH {P}, s AS (SELECT site, ord, pos, trim(x) AS sentence FROM (SELECT site, ord, unnest(xs) AS x, unnest(range(len(xs))) AS pos FROM (SELECT site, ord, string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS xs FROM p))),
f AS (SELECT site, sentence, min({{'o': ord, 'p': pos}}) AS o FROM s WHERE length(sentence) BETWEEN 13 AND 219 AND {q_any('sentence', di.SIGNALS['serviceArea'])} GROUP BY site, sentence) SELECT site, row_number() OVER (PARTITION BY site ORDER BY o) AS place, sentence FROM f QUALIFY place <= 8""")
def service_areas(spark, sf):
    return profile.service_areas(pages(spark, sf), K, di.SIGNALS["serviceArea"])


def q_phrases(lists: dict[str, list[str]]) -> str:
    cut = lambda xs: f"nullif(array_to_string(({q_labels({p: 'contains(lower(text), ' + q(p.lower()) + ')' for p in xs})})[1:3], ', '), '')"
    return ", ".join(f"{cut(xs)} AS {f}" for f, xs in lists.items())


@query(f"WITH {P} SELECT site, {q_phrases(di.DEMOGRAPHICS)} FROM p GROUP BY site")
def demographics(spark, sf):
    return profile.phrase_fields(pages(spark, sf), K, di.DEMOGRAPHICS)


@query(f"WITH {P} SELECT site, {q_phrases({'model': di.SIGNALS['businessModel']})} FROM p GROUP BY site")
def business_models(spark, sf):
    return profile.phrase_fields(pages(spark, sf), K, {"model": di.SIGNALS["businessModel"]})


# ---- evidence by signals


def q_bundle(parts: list[str], signals: list[str] | None, k: int = 6, spread: bool = True) -> str:
    rows = " UNION ALL ".join(f"SELECT site, source, {{'t': {i}, 'o': ord, 'p': pos}} AS o, text FROM ({x}) part{i}" for i, x in enumerate(parts))
    met = f"m AS (SELECT * FROM s WHERE {q_any('text', signals) if signals else 'text IS NOT NULL'})"
    turns = f"t AS (SELECT *, row_number() OVER (PARTITION BY site, source ORDER BY o) AS turn, min(o) OVER (PARTITION BY site, source) AS seat FROM m), r AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY turn, seat) AS place FROM t QUALIFY place <= {k})"
    ranked = turns if spread else "r AS (SELECT *, o AS place FROM m)"
    return f"WITH {P}, s AS ({rows}), {met}, {ranked}, b AS (SELECT * FROM r WHERE trim(text) <> '' QUALIFY row_number() OVER (PARTITION BY site, lower(text[1:160]) ORDER BY place) = 1) SELECT site, row_number() OVER (PARTITION BY site ORDER BY place) AS place, text FROM b QUALIFY row_number() OVER (PARTITION BY site ORDER BY place) <= {k}"


PROSE = "SELECT site, page_type AS source, ord, pos, text FROM p"
TIER = ["tier", "ord", "pos"]


def prose(p: DataFrame, column: str = "text") -> DataFrame:
    return p.select("site", F.col("page_type").alias("source"), "ord", "pos", F.col(column).alias("text"))


def by_signal(name: str):
    def run(spark, sf):
        return profile.signal_bundle(profile.tiers(K, prose(pages(spark, sf))), K, di.SIGNALS[name], TIER)

    return run


for _name, _signal in (("target_buyers", "targetBuyers"), ("customer_needs", "customerNeeds"), ("social_values", "values")):
    QUERIES[_name], ORACLES[_name] = by_signal(_signal), q_bundle([PROSE], di.SIGNALS[_signal])


@query(q_bundle([PROSE + " WHERE page_type = 'about'", PROSE], di.SIGNALS["foundingStory"], 2, False))
def founding_stories(spark, sf):
    s = prose(pages(spark, sf))
    return profile.signal_bundle(profile.tiers(K, s.filter("source = 'about'"), s), K, di.SIGNALS["foundingStory"], TIER, 2, False)


@query(q_bundle([PROSE + " WHERE page_type = 'blog'", PROSE], di.SIGNALS["industryOutlook"]))
def industry_outlooks(spark, sf):
    s = prose(pages(spark, sf))
    return profile.signal_bundle(profile.tiers(K, s.filter("source = 'blog'"), s), K, di.SIGNALS["industryOutlook"], TIER)


_PERSONA = di.SIGNALS["targetBuyers"] + di.SIGNALS["customerNeeds"]


@query(q_bundle([f"{PROSE} WHERE {q_any('text', _PERSONA)}", "SELECT site, 'testimonials' AS source, ord, pos, quote AS text FROM p WHERE quote IS NOT NULL"], None))
def ideal_personas(spark, sf):
    p = pages(spark, sf)
    stated = prose(p).filter(tx.any_phrase(F.col("text"), _PERSONA))
    voices = prose(p, "quote").filter("text IS NOT NULL").withColumn("source", F.lit("testimonials"))
    return profile.signal_bundle(profile.tiers(K, stated, voices), K, None, TIER)


@query(q_bundle([PROSE, "SELECT site, page_type AS source, ord, pos, item AS text FROM p"], di.SIGNALS["differentiators"]))
def differentiators(spark, sf):
    p = pages(spark, sf)
    return profile.signal_bundle(profile.tiers(K, prose(p), prose(p, "item")), K, di.SIGNALS["differentiators"], TIER)


_CUTS = "SELECT site, source, ord, pos, said AS text FROM (SELECT site, page_type AS source, ord, pos, coalesce(name, 'This product') || ': was ' || was || ', now ' || now || '.' AS said FROM p WHERE was <> now QUALIFY row_number() OVER (PARTITION BY site, lower(said) ORDER BY ord) = 1) QUALIFY row_number() OVER (PARTITION BY site ORDER BY ord) <= 6"
_SALE = lambda c: f"SELECT site, page_type AS source, ord, pos, {c} AS text FROM p WHERE {q_any(c, di.SIGNALS['promotions'])}"


@query(q_bundle([_SALE("text"), _CUTS, _SALE("heading"), _SALE("item")], None, 3, False))
def promotions(spark, sf):
    p, on = pages(spark, sf), lambda c: prose(p, c).filter(tx.any_phrase(F.col("text"), di.SIGNALS["promotions"]))
    cuts = profile.discounts(p.select("site", F.col("page_type").alias("source"), "ord", "pos", "name", "was", "now"), K)
    return profile.signal_bundle(profile.tiers(K, on("text"), cuts, on("heading"), on("item")), K, None, TIER, 3, False)


_STYLE = "SELECT site, ord, text, CASE WHEN page_type = 'homepage' THEN 'declared' ELSE 'prose' END AS kind FROM p WHERE site % 3 > 0 OR page_type = 'homepage' UNION ALL SELECT site, ord, heading, 'heading' FROM p UNION ALL SELECT site, ord, item, 'name' FROM p"


@query(f"""WITH {P}, s AS ({_STYLE}), f AS (SELECT *, bool_or(kind = 'prose' AND length(text) >= 40) OVER (PARTITION BY site) AS long, bool_or(kind = 'prose') OVER (PARTITION BY site) AS anyp FROM s WHERE text IS NOT NULL),
g AS (SELECT *, list_position(['prose', 'declared', 'heading', 'name'], kind) AS tier FROM f WHERE kind = 'prose' AND (NOT long OR length(text) >= 40) OR kind IN ('declared', 'heading') OR kind = 'name' AND NOT anyp), t AS (SELECT *, row_number() OVER (PARTITION BY site, tier ORDER BY ord) AS turn FROM g),
r AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY turn, tier) AS place FROM t QUALIFY place <= 6), b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY site, lower(text[1:160]) ORDER BY place) = 1) SELECT site, row_number() OVER (PARTITION BY site ORDER BY place) AS place, text FROM b""")
def writing_styles(spark, sf):
    p = pages(spark, sf)
    kind = F.when(F.col("page_type") == "homepage", "declared").otherwise("prose")
    own = p.filter("site % 3 > 0 OR page_type = 'homepage'").select("site", "ord", "text", kind.alias("kind"))
    rows = own.union(p.select("site", "ord", "heading", F.lit("heading"))).union(p.select("site", "ord", "item", F.lit("name")))
    return profile.writing_style(rows.filter("text IS NOT NULL"), K)


# ---- channels, funnels, calls to action, images, people


_IN = lambda names: "vendor IN (" + ", ".join(map(q, names)) + ")"
_CHANNELS = {"Online (website forms)": "cta_kind = 'form'", "Phone": "cta_kind = 'tel' OR phone IS NOT NULL", "Email": "cta_kind = 'mailto' OR email IS NOT NULL", "Online booking": f"cta_kind = 'booking' OR {_IN(profile.BOOKING)}", "Online ordering / e-commerce": _IN(profile.COMMERCE), "Social media": "social IS NOT NULL", "In person (physical location)": "address IS NOT NULL"}
_SAY = lambda n, c: f"coalesce(regexp_matches({c}, {q(resolve.FUNNEL_LABELS[n])}), false)"
_FUNNELS = {
    "Newsletter signup": f"{_SAY('Newsletter signup', 'cta_label')} OR coalesce({_IN(profile.NEWSLETTER)}, false)", "Contact form": f"{_SAY('Contact form', 'cta_label')} OR coalesce(cta_kind = 'form' AND regexp_matches(cta_label, '(?i)contact|message|enquir|inquir|get in touch'), false)",
    "Quote / estimate request": _SAY("Quote / estimate request", "cta_label"), "Appointment scheduler": f"{_SAY('Appointment scheduler', 'cta_label')} OR coalesce({_IN(profile.BOOKING)}, false)", "Demo request": _SAY("Demo request", "cta_label"), "Content marketing (blog)": "page_type = 'blog'",
    "Educational content (FAQs)": "page_type = 'faq' OR n_faq >= 3", "Testimonials and social proof": "quote IS NOT NULL", "Financing options": _SAY("Financing options", "text"), "Partnership / reseller program": _SAY("Partnership / reseller program", "text"),
    "Free inspection or assessment": f"{_SAY('Free inspection or assessment', 'cta_label')} OR coalesce(regexp_matches(cta_label, '(?i)\\bfree analysis\\b'), false) OR {_SAY('Free inspection or assessment', 'text')}", "Live chat": _IN(profile.CHAT),
}


@query(f"WITH {P} SELECT site, array_to_string({q_labels(_CHANNELS)}, '; ') AS labels FROM p GROUP BY site")
def site_channels(spark, sf):
    return profile.site_channels(pages(spark, sf), K).select("site", F.array_join("labels", "; ").alias("labels"))


@query(f"WITH {P} SELECT site, array_to_string({q_labels(_FUNNELS)}, '; ') AS labels FROM p GROUP BY site")
def site_funnels(spark, sf):
    return profile.site_funnels(pages(spark, sf), K, resolve.FUNNEL_LABELS).select("site", F.array_join("labels", "; ").alias("labels"))


@query(f"""WITH {P}, u AS (SELECT site, 0 AS tier, ord, 0 AS pos, cta_kind AS kind, cta_label AS label, cta_href AS href FROM p WHERE cta_kind IS NOT NULL UNION ALL SELECT site, 1, ord, 0, 'tel', phone, 'tel:' || regexp_replace(phone, '[^0-9+]', '', 'g') FROM p WHERE phone IS NOT NULL UNION ALL SELECT site, 1, ord, 1, 'mailto', email, 'mailto:' || email FROM p WHERE email IS NOT NULL),
k AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY site, kind || '::' || lower(coalesce(label, '')) ORDER BY tier, ord, pos) = 1) SELECT site, row_number() OVER (PARTITION BY site ORDER BY tier, ord, pos) AS place, kind, label, href FROM k QUALIFY place <= 30""")
def site_ctas(spark, sf):
    return profile.site_ctas(pages(spark, sf), K)


_VIA = cycle("o_orderkey", [*profile.IMAGE_RANK, "other"])
_LOGOS = f"SELECT o_custkey AS site, o_orderkey AS ord, 'https://i.example/' || (o_orderkey % 9) || '.png' AS url, CASE WHEN o_orderkey % 2 = 0 THEN 'Logo ' || (o_orderkey % 3) ELSE ' ' END AS alt, {_VIA} AS via FROM orders"
_PREVIEWS = "SELECT o_custkey AS site, o_orderkey AS ord, 'https://i.example/' || (o_orderkey % 9) || '.png' AS url, CASE WHEN o_orderkey % 5 = 0 THEN 'Seen  ' || o_orderkey END AS alt FROM orders"


@query(f"""WITH l AS ({_LOGOS}), v AS ({_PREVIEWS}), a AS (SELECT site, url, regexp_replace(arg_max(alt, ord) FILTER (WHERE alt IS NOT NULL), '\\s+', ' ', 'g') AS preview FROM v GROUP BY site, url), o AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY site, url ORDER BY ord) = 1)
SELECT o.site, row_number() OVER (PARTITION BY o.site ORDER BY coalesce(list_position([{', '.join(map(q, profile.IMAGE_RANK))}], via), 99), ord) AS place, o.url, coalesce(preview, nullif(trim(alt), '')) AS alt, via FROM o LEFT JOIN a ON o.site = a.site AND o.url = a.url QUALIFY place <= 4""")
def art_styles(spark, sf):
    o = table(spark, sf, "orders")
    logos = o.selectExpr("o_custkey AS site", "o_orderkey AS ord", "'https://i.example/' || (o_orderkey % 9) || '.png' AS url", "CASE WHEN o_orderkey % 2 = 0 THEN 'Logo ' || (o_orderkey % 3) ELSE ' ' END AS alt", f"{_VIA} AS via")
    previews = o.selectExpr("o_custkey AS site", "o_orderkey AS ord", "'https://i.example/' || (o_orderkey % 9) || '.png' AS url", "CASE WHEN o_orderkey % 5 = 0 THEN 'Seen  ' || o_orderkey END AS alt")
    return profile.art_style(logos, previews, K)


@query(f"WITH {P} SELECT site, place, person FROM ({_TIERED.format('''SELECT site, ord, 'Ann ' || (ord % 7) AS person, lower('Ann ' || (ord % 7)) AS same, CASE WHEN page_type = 'about' THEN 1 ELSE 2 END AS tier FROM p WHERE page_type IN ('about', 'services')''')}) WHERE place <= 40")
def key_people(spark, sf):
    p = pages(spark, sf).filter("page_type IN ('about', 'services')").withColumn("person", F.concat(F.lit("Ann "), (F.col("ord") % 7).cast("string")))
    return profile.preferred_first(p, K, ["about"], F.lower("person"), 40).select("site", "place", "person")


@query(f"WITH {P} SELECT site, place, quote, 'Company website' AS said_on FROM ({_TIERED.format('''SELECT site, ord, quote, lower(quote[1:120]) AS same, CASE page_type WHEN 'blog' THEN 1 WHEN 'about' THEN 2 ELSE 3 END AS tier FROM p WHERE quote IS NOT NULL''')}) WHERE place <= 30")
def site_testimonials(spark, sf):
    p = pages(spark, sf).filter("quote IS NOT NULL")
    return profile.preferred_first(p, K, ["blog", "about"], F.lower(F.substring("quote", 1, 120)), 30).select("site", "place", "quote", F.lit("Company website").alias("said_on"))


@query(f"WITH {P} SELECT site, place, vendor, kind FROM ({_TIERED.format('''SELECT site, ord, vendor, vendor AS same, 1 AS tier FROM p WHERE vendor IS NOT NULL''')}) JOIN (VALUES {', '.join(f'({q(k)}, {q(v[0])})' for k, v in di.VENDOR_KINDS.items())}) kinds(name, kind) ON vendor = name")
def site_partners(spark, sf):
    kind = F.coalesce(*[F.when(F.col("vendor") == k, F.lit(v[0])) for k, v in di.VENDOR_KINDS.items()])
    return profile.preferred_first(pages(spark, sf).filter("vendor IS NOT NULL"), K, [], F.col("vendor"), 60).select("site", "place", "vendor", kind.alias("kind"))


# ---- discovery and markup


@query("SELECT s_suppkey AS id, 'index' AS from_map, 'https://x.com/a' AS loc FROM supplier WHERE s_suppkey % 2 = 1 UNION ALL SELECT s_suppkey, 'child', 'https://x.com/' || k || '-' || s_suppkey FROM supplier, (VALUES ('pages'), ('posts'), ('misc')) v(k) WHERE s_suppkey % 2 = 0")
def sitemap_fetch(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"))
    index = "<sitemapindex>" + "".join(f"<sitemap><loc>https://x.com/{k}.xml</loc></sitemap>" for k in ("products", "misc", "posts", "pages")) + "</sitemapindex>"
    roots = s.withColumn("xml", F.when(F.col("id") % 2 == 0, index).otherwise("<urlset><url><loc>https://x.com/a</loc></url></urlset>"))
    kids = s.select("id", F.explode(F.array(*map(F.lit, ["products", "misc", "posts", "pages"]))).alias("k"))
    bodies = kids.select("id", F.concat(F.lit("https://x.com/"), "k", F.lit(".xml")).alias("loc"), F.concat(F.lit("<urlset><url><loc>https://x.com/"), "k", F.lit("-"), "id", F.lit("</loc></url></urlset>")).alias("xml"))
    return extract.sitemap_pages(roots, bodies)


@query("SELECT s_suppkey AS page_id, place, 'https://www.site' || s_suppkey || '.example.com/' || f AS sheet FROM supplier, (VALUES (1, 'a.css'), (2, 'b.css'), (3, 'c.css')) v(place, f)")
def stylesheets(spark, sf):
    html = F.lit('<link rel="stylesheet" href="/a.css"><link href="b.css" rel="alternate stylesheet"><link rel=stylesheet href="/a.css#x"><link rel="icon" href="/i.ico"><link rel="stylesheet" href="/c.css"><link rel="stylesheet" href="/d.css">')
    p = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("page_id"), F.concat(F.lit("https://www.site"), "s_suppkey", F.lit(".example.com/")).alias("url"), html.alias("html"))
    return extract.stylesheets(p).withColumn("place", F.col("place").cast("int"))


@query("""SELECT page_id, pos - 1 AS pos, href FROM (SELECT page_id, xs, unnest(xs) AS href, unnest(range(1, len(xs) + 1)) AS pos FROM (SELECT page_id, regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<a href="([^"]*)"', 1) AS xs FROM pages)) WHERE href <> ''""")
def navigation_links(spark, sf):
    rows = extract.explode_relation(table(spark, sf, "pages"), dom.nav_links)
    return rows.filter("region = 0").select("page_id", F.col("pos").cast("long").alias("pos"), "href")


@query("SELECT page_id, pos - 1 AS pos, text FROM (SELECT s_suppkey AS page_id, unnest(['Supplier ' || s_name || ' makes tools.', 'First point', 'Well said.']) AS text, unnest([1, 2, 3]) AS pos FROM supplier)")
def main_contents(spark, sf):
    html = F.concat(F.lit("<body><nav><p>menu</p></nav><main><header><p>top</p></header><p>Supplier "), "s_name", F.lit(" makes tools.</p><ul><li>First point</li></ul><script>var p</script><blockquote>Well said.</blockquote><footer><p>end</p></footer></main><p>outside</p></body>"))
    p = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("page_id"), F.lit("https://x.com/").alias("url"), html.alias("html"))
    return extract.explode_relation(p, dom.main_content).select("page_id", F.col("pos").cast("int").alias("pos"), "text")


@query("SELECT site, array_to_string(list_filter(['about', 'contact', 'blog'], lambda x: NOT list_contains(seen, x)), ',') AS missing FROM (SELECT o_custkey AS site, list(DISTINCT CASE o_orderpriority WHEN '1-URGENT' THEN 'about' WHEN '2-HIGH' THEN 'contact' WHEN '4-NOT SPECIFIED' THEN 'blog' ELSE 'x' END) AS seen FROM orders GROUP BY o_custkey)")
def probed_types(spark, sf):
    return discover.to_probe(pages(spark, sf), K, ["about", "contact", "blog"], discover.PRIORITY).select("site", F.array_join("missing", ",").alias("missing"))


# ---- drafts, review and what is shown


FIELDS = [registry.Field("companyFoundation.overview", "foundation", 2, "longText", True), registry.Field("pitch", "positioning", 2, "longText", True), registry.Field("values", "extensions", 2, "longText"), registry.Field("tags", "people", 3, "stringList"), registry.Field("offerings", "offerings", 3, "objectList", True, ("name", "price"))]
_STATUS = lambda n: f"CASE WHEN doc_id % {n} = 0 THEN 'absent' ELSE 'found' END"
_VALUE = lambda n: f"CASE doc_id % {n} WHEN 0 THEN NULL WHEN 1 THEN '[MOCK Overview]' WHEN 2 THEN '  ' ELSE ' Written ' || doc_id || ' ' END"
_PATHS = {"companyFoundation.overview": (5, 7), "pitch": (4, 6), "values": (3, 5)}


def documents(spark, sf):
    text = lambda n: F.struct(F.expr(_STATUS(n)).alias("status"))
    entry = lambda name, price: F.struct(name.alias("name"), price.alias("price"))
    none = F.lit(None).cast("string")
    offers = F.array(entry(F.when(F.col("doc_id") % 3 > 0, F.lit("Saw")), none), entry(none, F.when(F.col("doc_id") % 2 == 0, F.lit("$5"))), entry(F.lit(" "), none))
    return table(spark, sf, "documents").select("doc_id", F.struct(text(5).alias("overview"), F.col("lang").alias("kept")).alias("companyFoundation"), text(4).alias("pitch"), text(3).alias("values"), F.array(F.lit(" a "), F.lit("")).alias("tags"), offers.alias("offerings"))


def reviews(spark, sf):
    rows = [F.struct(F.lit(p).alias("path"), F.expr(_VALUE(v)).alias("value"), F.expr(f"doc_id % {v} <> 3").alias("reviewed")) for p, (_, v) in _PATHS.items()]
    return table(spark, sf, "documents").select("doc_id", F.explode(F.array(*rows)).alias("r")).select("doc_id", "r.*").filter("value IS NOT NULL")


def q_review(path: str) -> str:
    n, v = _PATHS[path]
    return f"SELECT doc_id, {q(path)} AS path, {_STATUS(n)} AS status, {_VALUE(v)} AS value, CASE WHEN trim(coalesce({_VALUE(v)}, '')) = '' THEN CASE WHEN {_STATUS(n)} = 'absent' THEN 'absent-and-empty' ELSE 'empty' END WHEN doc_id % {v} = 3 OR starts_with(trim({_VALUE(v)}), '[MOCK') THEN 'unreviewed-placeholder' END AS problem FROM documents"


_REVIEW = " UNION ALL ".join(q_review(p) for p in _PATHS)


@query(f"SELECT doc_id, path, status, problem FROM ({_REVIEW})")
def review_problems(spark, sf):
    return drafts.review_join(documents(spark, sf), reviews(spark, sf), FIELDS, ["doc_id"]).select("doc_id", "path", "status", "problem")


_MSG = {k: "'" + m.replace("'", "''").replace("{}", "' || label || '") + "'" for k, m in drafts.MESSAGES.items()}
_PROBLEMS = f"""SELECT doc_id, path, problem AS reason, CASE problem WHEN 'absent-and-empty' THEN {_MSG['absent-and-empty']} WHEN 'empty' THEN {_MSG['empty']} ELSE {_MSG['unreviewed-placeholder']} END AS message FROM (SELECT *, CASE path WHEN 'pitch' THEN 'Pitch' ELSE 'Overview' END AS label FROM ({_REVIEW})) WHERE problem IS NOT NULL AND path <> 'values'
UNION ALL SELECT doc_id, 'offerings', 'no-entries', 'At least one Offering is required. Add one manually if the scan found none.' FROM documents WHERE doc_id % 3 = 0"""


@query(_PROBLEMS)
def draft_problems(spark, sf):
    return drafts.problem_rows(drafts.draft_to_final(documents(spark, sf), reviews(spark, sf), FIELDS, ["doc_id"]), ["doc_id"])


_TEXT = lambda p, a: f"max(CASE WHEN path = {q(p)} AND problem IS NULL THEN trim(value) END) AS {a}"


@query(f"""WITH r AS (SELECT doc_id, {_TEXT('companyFoundation.overview', 'overview')}, {_TEXT('pitch', 'pitch')}, {_TEXT('values', 'vals')} FROM ({_REVIEW}) GROUP BY doc_id), b AS (SELECT DISTINCT doc_id FROM ({_PROBLEMS}))
SELECT d.doc_id, b.doc_id IS NULL AS ok, CASE WHEN b.doc_id IS NULL THEN overview END AS overview, CASE WHEN b.doc_id IS NULL THEN pitch END AS pitch, CASE WHEN b.doc_id IS NULL THEN vals END AS social_values, d.lang AS kept, 'a' AS tags, CAST(CAST(d.doc_id % 3 > 0 AS INT) + CAST(d.doc_id % 2 = 0 AS INT) AS INT) AS n_offerings
FROM documents d JOIN r ON d.doc_id = r.doc_id LEFT JOIN b ON d.doc_id = b.doc_id""")
def final_documents(spark, sf):
    f = drafts.draft_to_final(documents(spark, sf), reviews(spark, sf), FIELDS, ["doc_id"])
    return f.select("doc_id", "ok", F.col("companyFoundation.overview").alias("overview"), "pitch", F.col("values").alias("social_values"), F.col("companyFoundation.kept").alias("kept"), F.array_join("tags", ",").alias("tags"), F.size("offerings").alias("n_offerings"))


@query(f"SELECT doc_id, path, CASE WHEN status = 'found' THEN '[MOCK ' || CASE path WHEN 'pitch' THEN 'Pitch' WHEN 'values' THEN 'Values' ELSE 'Overview' END || ']' ELSE '' END AS value, false AS reviewed FROM ({_REVIEW})")
def initial_reviews(spark, sf):
    return drafts.initial_review(documents(spark, sf), FIELDS, ["doc_id"])


@query(f"SELECT doc_id, path, status = 'found' OR (trim(coalesce(value, '')) <> '' AND trim(coalesce(value, '')) <> '[MOCK Overview]') AS shown FROM ({_REVIEW})")
def badges(spark, sf):
    rows = drafts.review_join(documents(spark, sf), reviews(spark, sf), FIELDS, ["doc_id"])
    return rows.select("doc_id", "path", drafts.badge(F.col("status"), F.col("value"), F.lit("[MOCK Overview]")).alias("shown"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'unknown-section' WHEN c_custkey % 4 = 1 THEN 'unknown-action' END AS problem FROM customer")
def section_requests(spark, sf):
    k = F.col("c_custkey") % 4
    section = F.when(k == 0, F.when(F.col("c_custkey") % 8 == 0, "wrong")).otherwise("market")
    return table(spark, sf, "customer").select("c_custkey", drafts.section_problem(section, F.when(k == 1, "drop").when(k == 2, "hide").otherwise("restore")).alias("problem"))


@query("SELECT c_custkey, path, grp, grp = CASE c_custkey % 4 WHEN 0 THEN 'positioning' WHEN 1 THEN 'market' WHEN 2 THEN 'offerings' END IS TRUE AS hidden FROM customer, (VALUES ('companyFoundation.overview', 'foundation'), ('positioning.pitch', 'positioning'), ('offerings', 'offerings')) v(path, grp)")
def required_fields(spark, sf):
    owners = table(spark, sf, "customer")
    kind = F.col("c_custkey") % 4
    hidden = owners.select("c_custkey", F.when(kind == 0, "positioning").when(kind == 1, "market").when(kind == 2, "offerings").alias("section"))
    return drafts.required_fields(owners, hidden.filter("section IS NOT NULL"), ["c_custkey"])


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'a|body' WHEN 1 THEN 'a|' WHEN 2 THEN '|body' ELSE '' END AS notes FROM documents")
def saved_notes(spark, sf):
    title, body = F.when(F.col("doc_id") % 4 < 2, "a"), F.when(F.col("doc_id") % 2 == 0, "body").otherwise("\u200b ")
    d = documents(spark, sf).withColumn("customNotes", F.array(F.struct(title.alias("title"), body.alias("body")), F.struct(F.lit(" ").alias("title"), F.lit(None).cast("string").alias("body"))))
    f = drafts.draft_to_final(d, reviews(spark, sf), FIELDS, ["doc_id"])
    shown = F.transform("customNotes", lambda n: F.concat(F.coalesce(n["title"], F.lit("")), F.lit("|"), F.trim(F.regexp_replace(F.coalesce(n["body"], F.lit("")), "\u200b", ""))))
    return f.select("doc_id", F.array_join(shown, ";").alias("notes"))


@query("SELECT doc_id, lang AS got, CAST(NULL AS VARCHAR) AS absent, upper(lang) AS new_value, CASE WHEN doc_id % 5 = 0 THEN 'absent' ELSE 'found' END AS beside FROM documents")
def dotted_paths(spark, sf):
    d = documents(spark, sf)
    moved = drafts.set_path(d.withColumn("got", drafts.get_path(d, "companyFoundation.kept")).withColumn("absent", drafts.get_path(d, "companyFoundation.nothing.here").cast("string")), "companyFoundation.kept", F.upper("companyFoundation.kept"))
    return moved.select("doc_id", "got", "absent", F.col("companyFoundation.kept").alias("new_value"), F.col("companyFoundation.overview.status").alias("beside"))


_VERSIONS = "SELECT o_orderkey AS id, o_custkey AS company_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS v FROM orders"


@query(f"""SELECT k.id, k.company_id, coalesce(h, '') AS hidden_sections, n AS n_versions FROM ({_VERSIONS}) k JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) c ON k.company_id = c.o_custkey
LEFT JOIN (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'market,people' ELSE 'people' END AS h FROM customer WHERE c_custkey % 4 > 0) s ON s.c_custkey = k.company_id WHERE v = 1""")
def documents_with_versions(spark, sf):
    from ..operators import repository

    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("company_id"), F.col("o_orderdate").alias("created_at"), F.col("o_orderkey").alias("seq"))
    c = F.col("c_custkey")
    states = F.array(F.struct(F.lit("people").alias("section"), (c % 4 > 0).alias("hidden")), F.struct(F.lit("market").alias("section"), ((c % 3 == 0) & (c % 4 > 0)).alias("hidden")))
    s = table(spark, sf, "customer").select(c.alias("company_id"), F.explode(states).alias("s")).select("company_id", "s.*")
    return drafts.with_versions(repository.current(o), s, repository.versions(o)).withColumn("hidden_sections", F.array_join("hidden_sections", ","))


@query("SELECT c_nationkey, c_custkey, place, place // 3 AS grid_row FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_name) - 1 AS place FROM customer) WHERE place // 3 BETWEEN 1 AND 6")
def card_grid(spark, sf):
    return drafts.grid(table(spark, sf, "customer").select("c_nationkey", "c_custkey", "c_name"), ["c_nationkey"], ["c_name"], 3, 3, 2).drop("c_name")


_LIN = lambda i: f"(SELECT CASE WHEN v <= 0.03928 THEN v / 12.92 ELSE pow((v + 0.055) / 1.055, 2.4) END FROM (SELECT ((p_partkey * {i}) % 256) / 255.0 AS v))"


@query(f"SELECT p_partkey, CASE WHEN p_size >= 70 THEN 'good' WHEN p_size >= 40 THEN 'fair' ELSE 'poor' END AS tone, upper(p_name[1:1] || CASE WHEN contains(p_name, ' ') THEN string_split(p_name, ' ')[-1][1:1] ELSE '' END) AS initials, CASE WHEN 0.2126 * {_LIN(7)} + 0.7152 * {_LIN(31)} + 0.0722 * {_LIN(53)} > 0.179 THEN 'black' ELSE 'white' END AS ink FROM part")
def card_looks(spark, sf):
    two = lambda i: F.lpad(F.lower(F.hex((F.col("p_partkey") * i) % 256)), 2, "0")
    return table(spark, sf, "part").select("p_partkey", drafts.tone(F.col("p_size")).alias("tone"), drafts.initials(F.col("p_name")).alias("initials"), drafts.ink(F.concat(F.lit("#"), two(7), two(31), two(53))).alias("ink"))


@query(f"SELECT site, 'values' AS task, place, '[' || place || '] ' || text AS line FROM ({q_bundle([PROSE], di.SIGNALS['values'])})")
def prompt_inputs(spark, sf):
    return drafts.prompt_inputs(QUERIES["social_values"](spark, sf), K, "values")


@query("SELECT c_custkey, c_nationkey AS tenant FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def tenant_rows(spark, sf):
    members = table(spark, sf, "nation").select(F.col("n_nationkey").alias("tenant"), F.concat(F.lit("user"), "n_regionkey").alias("user"))
    return drafts.tenant_view(table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("tenant")), members, "user1")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 40 OR l_linenumber * 9 >= 45 OR l_linenumber * 9 + l_quantity > 45 THEN 'timeout' END AS reason FROM lineitem")
def page_deadlines(spark, sf):
    tries = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_linenumber") * 9).alias("start_ms"), F.col("l_quantity").alias("took_ms"))
    return drafts.deadline(tries, ["l_orderkey"], 40, 45).select("l_orderkey", "l_linenumber", "reason")
