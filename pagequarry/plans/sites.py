"""Queries over whole sites of generated and given pages, through one parse of each page.

Sites are customers and their orders are pages. A page's markup shows what stands
in the order's lines (offers, people, quotes and questions are parts and
suppliers), with structured data, calls to action and a footer; the SQL reads the
same from the tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dictionaries as di
from ..functions import urls
from ..operators import discover, entities, extract, parsed, profile, snippets, structured, table_functions
from ..sources.captured import CapturedPages
from ..sources.tables import exports, scratch, table, tasks
from .profile import P as PROFILE_P
from .profile import SENTENCES, cycle, q, q_any, q_bundle, q_labels

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
K = ["site"]
TYPES = ["homepage", "about", "team", "services", "faq", "testimonials", "contact"]
PAGE_TYPE = cycle("o_orderkey", TYPES)
TEXT = cycle("o_orderkey", SENTENCES)
NODE = "(o_custkey * 7 + o_orderkey) % 6"
YEAR = "1900 + o_orderkey % 90"


def query(sql: str):
    def add(fn):
        QUERIES[fn.__name__] = fn
        ORACLES[fn.__name__] = sql
        return fn

    return add


def _sql(expr: str) -> str:
    """An expression over the orders as the markup has it."""
    return f"CAST({expr} AS STRING)"


def site_pages(spark: SparkSession, sf: str) -> DataFrame:
    """(site, ord, page_type, html) of every order."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    named = lines.join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    said = lambda *xs: F.concat(*[F.lit(x[1:]) if x[0] == "'" else F.col(x).cast("string") for x in xs])
    named = named.withColumns({"price": F.floor("p_retailprice").cast("long"), "size": F.col("p_size").cast("long"), "lead": F.col("s_nationkey").cast("long"), "who": F.when(F.col("s_suppkey") % 3 == 0, "He").when(F.col("s_suppkey") % 3 == 1, "She").otherwise("They")})
    card = said("'<div class=\"product-card\" data-category=\"", "p_type", "'\"><h3>", "p_name", "' ", "p_brand", "'</h3><p>", "p_type", "'</p><span>$", "price", "'</span></div>")
    person = said("'<div class=\"team-member\"><h4>", "s_name", "'</h4><span class=\"role\">Lead ", "lead", "'</span><p>", "who", "' worked with us for years.</p></div>")
    quote = said("'<blockquote>“The ", "p_name", "' of ", "p_brand", "' came on time”<cite>— ", "s_name", "'</cite></blockquote>")
    asked = said("'<details><summary>How big is the ", "p_name", "'?</summary>Size ", "size", "' of ", "p_brand", "'.</details>")
    # each line gives what its page shows alone, in the order of cards, people, quotes and questions: no page shows more than two of them
    kind = F.expr(cycle("l_orderkey", TYPES))
    first = F.when(kind.isin("services", "homepage"), card).when(kind.isin("team", "about"), person).when(kind == "testimonials", quote).when(kind == "faq", asked)
    second = F.when(kind == "services", asked).when(kind == "homepage", person).when(kind == "about", quote)
    shown = named.filter(kind != "contact").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", first.alias("first"), second.alias("second")).alias("x"))
    pages = table(spark, sf, "orders")
    n = tasks(spark, pages.count())
    rows = shown.repartition(n, "l_orderkey").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("x")).alias("xs"))  # an order has seven lines at most
    blocks = rows.select("l_orderkey", F.concat(F.array_join("xs.first", ""), F.array_join("xs.second", "")).alias("blocks"))
    ld = [
        """'{"@type":"WebPage","name":"Page ' || o_orderkey || '"}'""",
        """'{"@graph":[{"@type":["Thing","AccountingService"],"name":"Books ' || o_orderkey || '","numberOfEmployees":{"value":' || (o_orderkey % 90) || '},"alternateName":["Alt ' || o_orderkey || '",7,"Firm B"]},{"@type":"BreadcrumbList","itemListElement":[{"name":"Home"},{"item":{"name":"Tools ' || o_custkey || '"}}]}]}'""",
        f"""'{{"@type":"' || CASE WHEN o_custkey % 3 = 0 THEN 'LocalBusiness' ELSE 'VideoObject' END || '","name":" Firm  ' || o_custkey || ' ","legalName":"Firm ' || o_custkey || ' Holdings, Inc.","additionalType":"http://schema.org/HardwareShop","foundingDate":"' || ({YEAR}) || '-02-01"}}'""",
        """'{"@type":"RoofingContractor","knowsAbout":["a"],"numberOfEmployees":' || (o_orderkey % 90) || ',"alternateName":"Roof ' || o_orderkey || '"}'""",
        """'{"@type":"ImageObject","name":"x"}'""",
        "'{broken'",
    ]
    node = f"CASE {NODE} " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(ld)) + " END"
    html = f"""'<html><head><title>Firm ' || o_custkey || ' | Page ' || o_orderkey || '</title>' || CASE WHEN o_orderkey % 6 = 0 THEN '<meta property="og:site_name" content="Firm ' || o_custkey || ' Online">' ELSE '' END
      || CASE WHEN o_orderkey % 5 = 0 THEN '<meta name="keywords" content="ab, hand tools ' || o_custkey || ', saws">' ELSE '' END || '<script type="application/ld+json">' || {node} || '</script>' || CASE WHEN o_orderkey % 50 = 0 THEN '<script src="https://cdn.shopify.com/x.js"></script>' ELSE '' END
      || '</head><body><main><h1>Order ' || o_orderkey || ' of firm ' || o_custkey || '</h1><p>' || {TEXT} || '</p>' || coalesce(blocks, '') || '</main><a class="btn" href="/order/' || o_orderkey || '">Order number ' || (o_orderkey % 50) || '</a>'
      || CASE WHEN page_type = 'contact' THEN '<a href="tel:(555) 010-' || (1000 + o_orderkey % 9000) || '">Call now</a><a href="mailto:m' || (o_orderkey % 9) || '@firm.example?subject=x">m</a>' ELSE '' END
      || '<footer>' || CASE WHEN o_orderkey % 4 = 0 THEN 'certified by the board of firm ' || (o_orderkey % 12) || ' in ' || ({YEAR}) || '. ' ELSE '' END || 'All rights reserved.</footer></body></html>'"""
    orders = pages.repartition(n, "o_orderkey").withColumn("page_type", F.expr(PAGE_TYPE)).join(blocks, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return orders.select(F.col("o_custkey").alias("site"), F.col("o_orderkey").alias("ord"), "page_type", F.expr(html).alias("html"))


def facts(spark: SparkSession, sf: str, *relations: str, saying: dict[str, list[str]] | None = None) -> DataFrame:
    return parsed.parse(site_pages(spark, sf), relations, saying=saying)


P = f"p AS MATERIALIZED (SELECT o_custkey AS site, o_orderkey AS ord, {PAGE_TYPE} AS page_type, {TEXT} AS text, {NODE} AS node, {YEAR} AS year FROM orders)"
L = f"{P}, l AS MATERIALIZED (SELECT site, ord, page_type, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS pos, part.*, supplier.* FROM p JOIN lineitem ON l_orderkey = ord JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey)"
#: the node that the site's owner has: (rank, ord) decides
ORG = """o AS (SELECT site, arg_min({'ord': ord, 'node': node, 'year': year}, (rank, ord)) AS n FROM (SELECT *, CASE WHEN node = 2 AND site % 3 = 0 THEN 0 WHEN node IN (1, 3) THEN 1 END AS rank FROM p) WHERE rank IS NOT NULL GROUP BY site),
tr AS (SELECT site, ['Home', 'Tools ' || site] AS trail FROM p WHERE node = 1 GROUP BY site),
org AS MATERIALIZED (SELECT s.site, CASE n.node WHEN 1 THEN 'Books ' || n.ord WHEN 2 THEN 'Firm ' || s.site END AS name, CASE n.node WHEN 2 THEN 'Firm ' || s.site || ' Holdings, Inc.' END AS legal,
  CASE n.node WHEN 1 THEN ['Alt ' || n.ord, 'Firm B'] WHEN 3 THEN ['Roof ' || n.ord] ELSE [] END AS alternates, CASE n.node WHEN 1 THEN ['Thing', 'AccountingService'] WHEN 2 THEN ['LocalBusiness'] WHEN 3 THEN ['RoofingContractor'] ELSE [] END AS types,
  CASE n.node WHEN 1 THEN 'Thing' WHEN 2 THEN 'Hardware Shop' WHEN 3 THEN 'Roofing Contractor' END AS industry, CASE n.node WHEN 2 THEN n.year END AS founded, CASE WHEN n.node IN (1, 3) THEN CAST(n.ord % 90 AS VARCHAR) END AS staff, trail
  FROM (SELECT DISTINCT site FROM p WHERE node <> 5) s LEFT JOIN o USING (site) LEFT JOIN tr USING (site))"""
HOME = "h AS MATERIALIZED (SELECT site, arg_min(ord, (page_type <> 'homepage', ord)) AS ord FROM p GROUP BY site), hv AS (SELECT site, CASE WHEN ord % 6 = 0 THEN 'Firm ' || site || ' Online' END AS og, 'Firm ' || site AS title, CASE WHEN ord % 5 = 0 THEN 'hand tools ' || site END AS keyword FROM h)"


def _organizations(rows: DataFrame) -> DataFrame:
    return structured.organizations(parsed.of(rows, "json_ld"), K)


def _home(rows: DataFrame) -> DataFrame:
    """(site, og_name, title, keywords) of each site's homepage: rows parsed with meta and title."""
    at = F.struct(F.col("page_type") != "homepage", "ord")
    first = rows.groupBy(*K, "ord", "page_type").agg(
        F.max(F.col("title.text")).alias("title"), F.max_by(F.col("meta.value"), F.when(F.col("meta.name") == "og:site_name", F.col("pos"))).alias("og_name"), F.max_by(F.col("meta.value"), F.when(F.col("meta.name") == "keywords", F.col("pos"))).alias("keywords")
    )
    return first.groupBy(*K).agg(*[F.min_by(c, at).alias(c) for c in ("og_name", "title", "keywords")])


@query(f"WITH {P}, {ORG} SELECT site, name, legal, array_to_string(alternates, '|') AS alternates, array_to_string(types, '|') AS types, industry, founded, staff, array_to_string(trail, '|') AS trail FROM org")
def site_organizations(spark, sf):
    joined = {c: F.array_join(c, "|") for c in ("alternates", "types", "trail")}
    return _organizations(facts(spark, sf, "json_ld")).withColumns(joined)


_ALTS = "list_filter(list_concat(coalesce(alternates, []), [legal, og, dba]), lambda x: x IS NOT NULL AND x <> '')"


@query(f"""WITH {P}, {ORG}, {HOME}, d AS (SELECT site, arg_min(dba, ord) AS dba FROM (SELECT site, ord, nullif(trim(regexp_extract(text, {q(profile.DBA)}, 1)), '') AS dba FROM p) WHERE dba IS NOT NULL GROUP BY site),
x AS (SELECT hv.site, coalesce(name, legal, og, title) AS name, {_ALTS} AS alts FROM hv LEFT JOIN org USING (site) LEFT JOIN d USING (site)),
a AS (SELECT site, string_agg(alt, '|' ORDER BY i) AS alts FROM (SELECT site, alt, min(i) AS i FROM (SELECT site, unnest(alts) AS alt, unnest(range(len(alts))) AS i, name FROM x) WHERE lower(alt) <> lower(name) GROUP BY site, alt) GROUP BY site)
SELECT site, name, coalesce(a.alts, '') AS alternatives FROM x LEFT JOIN a USING (site)""")
def site_names(spark, sf):
    rows = facts(spark, sf, "json_ld", "meta", "title", "main", saying={"main": profile.DBA_PHRASES}).persist()
    dba = structured.doing_business_as(parsed.of(rows, "main"), K, ["ord", "pos"])
    return structured.names(_organizations(rows), _home(rows), dba, K).withColumn("alternatives", F.array_join("alternatives", "|"))


OFFERS = "f AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY page_type <> 'services', ord, pos) AS place FROM (SELECT site, ord, page_type, pos, p_name || ' ' || p_brand AS name, p_type AS category, p_type AS description, '$' || CAST(floor(p_retailprice) AS BIGINT) AS price FROM l WHERE page_type IN ('services', 'homepage') QUALIFY row_number() OVER (PARTITION BY site, lower(name) ORDER BY page_type <> 'services', ord, pos) = 1)) WHERE place <= 60)"


@query(f"WITH {L}, {OFFERS} SELECT site, place, name, category, description, price FROM f")
def site_offers(spark, sf):
    return entities.offers(parsed.of(facts(spark, sf, "offer"), "offer"), K)


@query(f"""WITH {L}, {OFFERS}, {ORG}, {HOME}, c AS (SELECT site, lower(category) AS low, count(*) AS n, min(place) AS place, arg_min(category, place) AS category FROM f GROUP BY ALL),
b AS (SELECT site, arg_min(category, (-n, place)) AS category, max(n) AS n, count(*) AS kinds FROM c GROUP BY site)
SELECT hv.site, coalesce(industry, CASE WHEN b.n >= 2 OR kinds = 1 THEN category END, keyword, CASE WHEN trail IS NOT NULL THEN trail[2] END) AS industry FROM hv LEFT JOIN org USING (site) LEFT JOIN b USING (site)""")
def site_industries(spark, sf):
    rows = facts(spark, sf, "json_ld", "meta", "title", "offer").persist()
    category = entities.common_category(entities.offers(parsed.of(rows, "offer"), K), K, di.GENERIC_CATEGORIES)
    return structured.industry(_organizations(rows), category, _home(rows), K)


_ROLE = " ".join(f"WHEN {' OR '.join(f'{chr(39)}{t}{chr(39)} = ANY(types)' for t in ts)} THEN {q(r)}" for r, ts in {"Service provider": ["AccountingService", "RoofingContractor"]}.items())


@query(f"""WITH {P}, {ORG}, t AS (SELECT site, {q_labels({k: q_any('text', v) for k, v in di.ROLES.items()})} AS r, {q_labels({k: q_any('text', v) for k, v in di.AUDIENCES.items()})} AS a, bool_or(ord % 50 = 0) AS shop FROM p GROUP BY site)
SELECT site, coalesce(CASE {_ROLE} END, CASE WHEN len(r) > 0 THEN trim(array_to_string(a, ' and ') || ' ' || r[1]) END, CASE WHEN shop THEN 'Retailer' END) AS role FROM t LEFT JOIN org USING (site)""")
def site_roles(spark, sf):
    rows = facts(spark, sf, "json_ld", "main", "reference", saying={"main": [p for ps in (*di.ROLES.values(), *di.AUDIENCES.values()) for p in ps]}).persist()
    vendors = extract.vendors_of(parsed.of(rows, "reference"), [*K, "ord"], ["pos"], di.VENDORS)
    shops = vendors.filter(F.col("name").isin(profile.SHOPS)).select(*K, "ord", F.lit(None).cast("string").alias("text"), F.col("name").alias("vendor"))
    said = rows.select(*K, "ord", F.col("main.text").alias("text"), F.lit(None).cast("string").alias("vendor"))  # rows of all relations: sites that say nothing of a role stay
    kinds = _organizations(rows).select(*K, structured.role_of(F.col("types")).alias("typed"))
    return profile.company_role(said.unionByName(shops), kinds, K, di.ROLES, di.AUDIENCES)


@query(f"""WITH {L}, n AS (SELECT site, ord, page_type, pos, s_name AS name, 'Lead ' || s_nationkey AS title, CASE s_suppkey % 3 WHEN 0 THEN 'Male' WHEN 1 THEN 'Female' END AS gender, CASE s_suppkey % 3 WHEN 0 THEN 'He' WHEN 1 THEN 'She' ELSE 'They' END || ' worked with us for years.' AS bio FROM l WHERE page_type IN ('team', 'about') QUALIFY row_number() OVER (PARTITION BY site, lower(name) ORDER BY page_type <> 'team', ord, pos) = 1)
SELECT site, row_number() OVER (PARTITION BY site ORDER BY page_type <> 'team', ord, pos) AS place, name, title, gender, bio FROM n QUALIFY place <= 40""")
def site_people(spark, sf):
    return entities.key_people(parsed.of(facts(spark, sf, "person"), "person"), K)


@query(f"""WITH {L}, n AS (SELECT site, ord, page_type, pos, 'The ' || p_name || ' of ' || p_brand || ' came on time' AS quote, s_name AS attributed_to FROM l WHERE page_type IN ('testimonials', 'about') QUALIFY row_number() OVER (PARTITION BY site, lower(quote) ORDER BY page_type <> 'testimonials', ord, pos) = 1)
SELECT site, row_number() OVER (PARTITION BY site ORDER BY page_type <> 'testimonials', ord, pos) AS place, quote, attributed_to FROM n QUALIFY place <= 30""")
def site_quotes(spark, sf):
    return entities.quotes(parsed.of(facts(spark, sf, "testimonial"), "testimonial"), K)


@query(f"""WITH {L}, n AS (SELECT site, ord, page_type, pos, 'How big is the ' || p_name || '?' AS question, 'Size ' || p_size || ' of ' || p_brand || '.' AS answer FROM l WHERE page_type IN ('faq', 'services') QUALIFY row_number() OVER (PARTITION BY site, lower(question) ORDER BY page_type <> 'faq', ord, pos) = 1)
SELECT site, row_number() OVER (PARTITION BY site ORDER BY page_type <> 'faq', ord, pos) AS place, question, answer FROM n QUALIFY place <= 40""")
def site_questions(spark, sf):
    return entities.questions(parsed.of(facts(spark, sf, "question"), "question"), K)


@query(f"""WITH {P}, n AS (SELECT site, ord, 'certified by the board of firm ' || (ord % 12) || ' in ' || year AS name, CAST(CASE WHEN year BETWEEN 1900 AND 2099 THEN year END AS INTEGER) AS year FROM p WHERE ord % 4 = 0 QUALIFY row_number() OVER (PARTITION BY site, lower(name) ORDER BY ord) = 1)
SELECT site, row_number() OVER (PARTITION BY site ORDER BY ord) AS place, name, year FROM n QUALIFY place <= 25""")
def site_certificates(spark, sf):
    return entities.certificates(parsed.of(facts(spark, sf, "credential"), "credential"), K)


@query(f"""WITH {P}, u AS (SELECT site, 0 AS tier, ord, 0 AS pos, 'link' AS kind, 'Order number ' || (ord % 50) AS label, '/order/' || ord AS href FROM p
UNION ALL SELECT site, 0, ord, 1, 'tel', 'Call now', 'tel:(555) 010-' || (1000 + ord % 9000) FROM p WHERE page_type = 'contact' UNION ALL SELECT site, 0, ord, 2, 'mailto', 'm', 'mailto:m' || (ord % 9) || '@firm.example?subject=x' FROM p WHERE page_type = 'contact'
UNION ALL SELECT site, 1, ord, 0, 'tel', '(555) 010-' || (1000 + ord % 9000), 'tel:555010' || (1000 + ord % 9000) FROM p WHERE page_type = 'contact' UNION ALL SELECT site, 1, ord, 1, 'mailto', 'm' || (ord % 9) || '@firm.example', 'mailto:m' || (ord % 9) || '@firm.example' FROM p WHERE page_type = 'contact'),
n AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY site, kind, lower(label) ORDER BY tier, ord, pos) = 1)
SELECT site, row_number() OVER (PARTITION BY site ORDER BY tier, ord, pos) AS place, kind, label, href FROM n QUALIFY place <= 30""")
def site_actions(spark, sf):
    rows = facts(spark, sf, "cta", "contact").persist()
    return entities.actions(parsed.of(rows, "cta"), parsed.of(rows, "contact"), K)


# ---- the given pages


#: the paragraphs of the given pages: what follows a <p> up to the next, in the article
_PARAS = r"""a AS (SELECT page_id, url, regexp_extract(html, '(?s)<article>(.*)', 1) AS body FROM pages),
x AS (SELECT page_id, url, regexp_extract_all(regexp_replace(regexp_replace(body, '(?s)</article>.*', ''), '</?(?:b|br|i|em|strong|span)>', '', 'g'), '<p>([^<]*)', 1) AS xs FROM a)"""
_SPACED = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"


def _decoded(x: str) -> str:
    for k, v in extract.ENTITIES.items():
        x = f"replace({x}, '{k}', '{v.replace(chr(39), chr(39) * 2)}')"
    return x


def given_pages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select(urls.site(F.col("url")).alias("site"), F.col("page_id").alias("ord"), F.lit("homepage").alias("page_type"), "html")


@query(f"WITH {_PARAS} SELECT ord, row_number() OVER (PARTITION BY ord ORDER BY i) AS place, text FROM (SELECT page_id AS ord, i, {_SPACED.format(_decoded('xs[i]'))} AS text FROM (SELECT page_id, xs, unnest(range(1, len(xs) + 1)) AS i FROM x)) WHERE length(text) >= 12 AND contains(text, ' ')")
def page_passages(spark, sf):
    said = snippets.prose(snippets.blocks(parsed.parse(given_pages(spark, sf), ["main"])))
    return said.select("ord", F.row_number().over(_by(["ord"], *snippets.ORDER)).cast("long").alias("place"), "text")


def _by(keys: list[str], *order: str):
    from pyspark.sql import Window

    return Window.partitionBy(*keys).orderBy(*order)


@query("SELECT page_id, CAST(i - 1 AS INTEGER) AS pos, text FROM (SELECT page_id, i, " + _SPACED.format(_decoded("xs[i]")) + " AS text FROM (SELECT page_id, xs, unnest(range(1, len(xs) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '<h1>([^<]*)', 1) AS xs FROM pages)))")
def headings_by_table_function(spark, sf):
    table_functions.register(spark)
    table(spark, sf, "pages").createOrReplaceTempView("captured_pages")
    return spark.sql("SELECT p.page_id, h.pos, h.text FROM captured_pages p, LATERAL page_heading(p.html) h WHERE h.level = 1")


_INTRO = "'Document ' || doc_id || ' of ' || coalesce(source, 'nobody') || ', kept here with all of its lines as they were written, so that readers, and those who quote it, find it whole and in order.'"


@query(f"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS place, text FROM (SELECT doc_id, i, {_SPACED.format('xs[i]')} AS text FROM (SELECT doc_id, xs, unnest(range(1, len(xs) + 1)) AS i FROM (SELECT doc_id, list_concat([{_INTRO}], string_split(text, chr(10))) AS xs FROM documents))) WHERE text <> ''""")
def scored_contents(spark, sf):
    """Nothing declares the content: it lies between a sidebar, a teaser and comments."""
    safe = lambda x: F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    lines = F.array_join(F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit("<p>"), safe(x), F.lit("</p>"))), "")
    html = F.concat(
        F.lit('<body><div class="sidebar"><ul><li>See also this, that, and the other long list of links and notes</li></ul></div><div><div class="teaser"><p>Read on</p></div><div class="entry"><p>'), F.expr(_INTRO), F.lit("</p>"), lines,
        F.lit('</div></div><div id="comments"><p>I read all of this, and liked it, and so did many others, I think, who wrote here.</p></div></body>'),
    )
    docs = table(spark, sf, "documents").filter("text IS NOT NULL").select("doc_id", html.alias("html"))
    rows = parsed.of(parsed.parse(docs, ["main"]), "main").filter("scored")
    return rows.select("doc_id", (F.col("pos") + 1).cast("long").alias("place"), "text")


# ---- links and signals over all dictionaries at once


_ALL = [(t, w) for t, ws in di.PAGE_TYPES.items() for w in ws]
_LINK_TEXT = f"[{', '.join(q(w) for _, w in _ALL)}]"


def _phrase_at(key: str) -> str:
    return f"element_at(array({', '.join(q(w) for _, w in _ALL)}), CAST({key} % {len(_ALL)} AS INT) + 1)"


_WORDS = lambda x: f"' ' || trim(regexp_replace(regexp_replace(regexp_replace(lower({x}), '[-_/]+', ' ', 'g'), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g')) || ' '"
_MET = lambda ws: " OR ".join(f"contains(hay, {q(f' {w} ')}) OR contains(hay, {q(f' {w}s ')})" for w in ws)
_TYPED = "list_filter([" + ", ".join(f"CASE WHEN {_MET(ws)} THEN '{t}' END" for t, ws in di.PAGE_TYPES.items()) + "], lambda x: x IS NOT NULL)"


@query(f"""WITH k AS (SELECT p_partkey, {_LINK_TEXT}[CAST(p_partkey % {len(_ALL)} AS INTEGER) + 1] AS w, p_name FROM part), n AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'Our ' || w || '!' WHEN p_partkey % 3 = 1 THEN p_name ELSE w || 'x' END AS text, '/' || CASE WHEN p_partkey % 2 = 0 THEN replace(p_name, ' ', '-') ELSE replace(w, ' ', '_') || 's' END AS path FROM k),
y AS (SELECT p_partkey, {_TYPED} AS types FROM (SELECT p_partkey, {_WORDS('text')} || chr(10) || {_WORDS('path')} AS hay FROM n)) SELECT p_partkey, array_to_string(types, ',') AS types, coalesce(types[1], 'unknown') AS primary_type FROM y""")
def link_types(spark, sf):
    w, c = F.expr(_phrase_at("p_partkey")), F.col
    text = F.when(c("p_partkey") % 3 == 0, F.concat(F.lit("Our "), w, F.lit("!"))).when(c("p_partkey") % 3 == 1, c("p_name")).otherwise(F.concat(w, F.lit("x")))
    path = F.when(c("p_partkey") % 2 == 0, F.replace("p_name", F.lit(" "), F.lit("-"))).otherwise(F.concat(F.replace(w, F.lit(" "), F.lit("_")), F.lit("s")))
    typed = table(spark, sf, "part").select("p_partkey", discover.page_types(text, F.concat(F.lit("https://firm.example/"), path, F.lit("?q=about")), di.PAGE_TYPES).alias("types"))
    return typed.select("p_partkey", F.array_join("types", ",").alias("types"), discover.primary_type(F.col("types")).alias("primary_type"))


_SIGNALS = [w for ws in di.SIGNALS.values() for w in ws]
_LINES = "(SELECT doc_id, pos, text || CASE WHEN (doc_id + pos) % 4 = 0 THEN ' ' || upper([" + ", ".join(q(w) for w in _SIGNALS) + f"][CAST((doc_id * 3 + pos) % {len(_SIGNALS)} AS INTEGER) + 1]) ELSE '' END AS text FROM (SELECT doc_id, unnest(range(len(xs))) AS pos, unnest(xs) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS xs FROM documents)))"


@query("WITH s AS (SELECT doc_id, pos, " + "list_filter([" + ", ".join(f"CASE WHEN {q_any('text', ws)} THEN '{n}' END" for n, ws in di.SIGNALS.items()) + f"], lambda x: x IS NOT NULL) AS signals FROM {_LINES}) SELECT doc_id, CAST(pos AS INTEGER) AS pos, array_to_string(signals, ',') AS signals FROM s WHERE len(signals) > 0")
def signals_of_lines(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    at = F.expr(f"element_at(array({', '.join(q(w) for w in _SIGNALS)}), CAST((doc_id * 3 + pos) % {len(_SIGNALS)} AS INT) + 1)")
    marked = lines.withColumn("text", F.concat("text", F.when((F.col("doc_id") + F.col("pos")) % 4 == 0, F.concat(F.lit(" "), F.upper(at))).otherwise("")))
    return snippets.with_signals(marked).filter(F.size("signals") > 0).select("doc_id", "pos", F.array_join("signals", ",").alias("signals"))


# ---- evidence, positioning, navigation, captures and exports


_REST = ["targetBuyers", "customerNeeds", "differentiators", "values"]


@query(" UNION ALL ".join(f"SELECT site, '{n}' AS field, place, text FROM ({q_bundle(['SELECT site, page_type AS source, ord, 0 AS pos, text FROM p'], di.SIGNALS[n]).replace(PROFILE_P, P)})" for n in _REST))
def site_evidence(spark, sf):
    """All fields' evidence from one table of snippets, whose signals are found in one pass."""
    said = snippets.passages_with_signals(facts(spark, sf, "main"), {n: di.SIGNALS[n] for n in _REST})
    rows = said.filter("text NOT RLIKE '^(He|She|They) worked|^“The .* came on time|^[A-Z]+$'").select("site", F.explode("signals").alias("field"), F.col("page_type").alias("source"), *snippets.ORDER, "text")
    return profile.signal_bundle(rows, ["site", "field"], None, snippets.ORDER).select("site", "field", "place", "text")


_KIND_RANK = {"overview": ["about", "declared", "homepage", "hero"], "pitch": ["hero", "declared", "homepage", "about"]}
_POOL = f"""WITH {P}, t AS (SELECT * FROM p), hm AS (SELECT site, ord, text, row_number() OVER (PARTITION BY site ORDER BY ord) AS nth FROM p WHERE page_type = 'homepage'),
pool AS (SELECT site, 'about' AS kind, ord, text FROM p WHERE page_type = 'about' UNION ALL SELECT site, 'homepage', ord, text FROM hm WHERE nth <= 3 UNION ALL SELECT site, 'hero', 0, 'Order ' || ord || ' of firm ' || site FROM hm WHERE nth = 1)"""


def _positioning(field: str):
    def run(spark, sf):
        # three parts read what is parsed and cleaned once; other pages' texts are no part of it
        rows = facts(spark, sf, "heading", "main").filter(F.col("page_type").isin("about", "homepage"))
        plain = rows.filter("relation <> 'main' OR main.text NOT RLIKE '^(He|She|They) worked|^“The .* came on time|^[A-Z]+$'")
        none = spark.createDataFrame([], "site long, text string")
        return snippets.positioning(snippets.blocks(plain).persist(), none, K, _KIND_RANK[field]).select("site", "place", "kind", "text")

    return run


for _field, _ranks in _KIND_RANK.items():
    _name = {"overview": "site_overviews", "pitch": "site_pitches"}[_field]
    QUERIES[_name] = _positioning(_field)
    ORACLES[_name] = f"{_POOL}, k AS (SELECT *, list_position({_ranks}, kind) AS r FROM pool), b AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY site, lower(text[1:160]) ORDER BY r, ord) = 1) SELECT site, row_number() OVER (PARTITION BY site ORDER BY r, ord) AS place, kind, text FROM b QUALIFY place <= 3"


@query("SELECT s_suppkey AS page_id, region, 'https://www.site' || s_suppkey || '.example.com/' || x AS target, upper(x) AS text, CASE WHEN region < 5 THEN 'nav-link' ELSE 'footer-link' END AS via FROM supplier, (VALUES (0, 'a'), (1, 'b'), (2, 'c'), (3, 'd'), (4, 'e'), (5, 'f'), (6, 'g')) v(region, x)")
def navigation_regions(spark, sf):
    html = F.lit('<nav><a href="/a#x">A</a><a href="https://other.example.org/">O</a></nav><header><a href="b">B</a></header><div role="navigation"><a href="/c"> C </a></div><div class="topNav"><a href="/d">D</a></div><div id="mainMenu"><a href="mailto:x@y.example">M</a><a href="/e">E</a></div><footer><a href="/f">F</a></footer><div class="page-Footer"><a href="/g">G</a></div><a href="/z">Z</a>')
    p = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("page_id"), F.concat(F.lit("https://www.site"), "s_suppkey", F.lit(".example.com/")).alias("url"), html.alias("html"))
    links = discover.navigation(parsed.of(parsed.parse(p, ["navigation"]), "navigation"), ["page_id"])
    return links.select("page_id", "region", "target", "text", "via")


@query("""SELECT url, CASE page_id % 7 WHEN 0 THEN 'dns' WHEN 1 THEN 'blocked' WHEN 2 THEN 'http-error' WHEN 3 THEN 'not-html' END AS reason, CASE page_id % 7 WHEN 0 THEN 'That domain could not be found.' WHEN 1 THEN 'The site refused the request (HTTP ' || (CASE WHEN page_id % 2 = 0 THEN 403 ELSE 429 END) || '). It may be blocking automated visitors.'
WHEN 2 THEN 'The server returned HTTP ' || (500 + page_id % 10) || '.' WHEN 3 THEN 'That address returned application/pdf, not a web page.' END AS message, CASE WHEN page_id % 7 > 3 THEN left(html, 2000) END AS body FROM pages""")
def captured_responses(spark, sf):
    spark.dataSource.register(CapturedPages)
    kind, page = F.col("page_id") % 7, F.col("page_id")
    status = F.when(kind == 1, F.when(page % 2 == 0, 403).otherwise(429)).when(kind == 2, 500 + page % 10).when(kind > 2, 200)
    answers = table(spark, sf, "pages").select("url", status.cast("int").alias("status"), F.when(kind == 3, "application/pdf;q=1").when(kind == 4, "TEXT/HTML; charset=utf-8").alias("content_type"), F.col("html").alias("body"), F.when(kind == 0, "ENOTFOUND").alias("error"))
    path = scratch(spark, "captured")
    answers.write.parquet(path)
    return spark.read.format("captured_pages").option("max_chars", "2000").load(path).select("url", "reason", "message", "body")


@query("SELECT 'customer-' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') || '.json' AS file, '{\"name\":\"' || c_name || '\",\"segment\":\"' || c_mktsegment || '\"}' AS value FROM customer")
def exported_documents(spark, sf):
    c = table(spark, sf, "customer").select("c_name", F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")).alias("data"))
    return exports(c, "c_name", "data")
