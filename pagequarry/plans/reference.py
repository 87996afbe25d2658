"""The registered queries over the driver's tables, each with the SQL that must give the same rows.

Where the tables lack markup that an operator reads, the query writes it from
relational columns first and the SQL selects those columns directly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dictionaries as di
from ..functions import text as tx
from ..functions import urls
from ..operators import discover, dom, extract, order, registry, repository, resolve
from ..sources.tables import domains, event_lines, export_name, prune_cache, table, tasks, to_lines
from ..streaming import progress

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SP = tx.SPACE
#: test vocabularies: the driver's texts have none of the stock phrases
NOISE_EXACT, NOISE_CONTAINS = ["the", "and", "of", "de", "la", "der"], ["tion", "heit"]
TYPES = {"about": ["the", "le"], "services": ["and", "la"], "contact": ["of", "de"], "blog": ["is", "der"]}
SIGNALS = ["license", "the thing", "wh the"]
PHRASES = ["mit license", "apache license", "general public license", "cc by", "the the"]
ROLES = {"Licensor": ["licensed under"], "Publisher": ["released under"], "Speaker": ["the and", "de la"]}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def q_collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{SP}+', ' ', 'g'))"


def q_decode(x: str) -> str:
    for k, v in extract.ENTITIES.items():
        x = f"replace({x}, '{k}', '{v.replace(chr(39), chr(39) * 2)}')"
    return x


def q_inner(x: str) -> str:
    return q_collapse(q_decode(f"regexp_replace({x}, '<[^>]*>', ' ', 'g')"))


def q_tags(tag: str) -> str:
    return f"(SELECT page_id, url, pos - 1 AS pos, {q_inner('xs[pos]')} AS text FROM (SELECT page_id, url, xs, unnest(range(1, len(xs) + 1)) AS pos FROM (SELECT page_id, url, regexp_extract_all(html, '(?is)<{tag}(?:\\s[^>]*)?>(.*?)</{tag}>', 1) AS xs FROM pages)))"


def q_list(xs: list[str]) -> str:
    return ", ".join("'" + x.replace("'", "''") + "'" for x in xs)


HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1))"
SITE = f"regexp_replace({HOST}, '^www\\.', '')"
LINES = "(SELECT doc_id, source, lang, pos - 1 AS pos, xs[pos] AS text FROM (SELECT doc_id, source, lang, xs, unnest(range(1, len(xs) + 1)) AS pos FROM (SELECT doc_id, source, lang, string_split(text, chr(10)) AS xs FROM documents)))"


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages")


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, source, lang, pos, text): documents as pages of snippets."""
    return table(spark, sf, "documents").select("doc_id", "source", "lang", F.posexplode(F.split("text", "\n")).alias("pos", "text"))


def long(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


# ---- sources and extraction over pages


@query(f"SELECT page_id, url, {HOST} AS host, {SITE} AS site, regexp_replace(regexp_replace(url, '#.*', ''), '\\?$', '') AS bare, lower(regexp_extract(url, '^([a-zA-Z]+):', 1)) || '://' || {SITE} AS website FROM pages")
def page_addresses(spark, sf):
    u = F.col("url")
    return pages(spark, sf).select("page_id", "url", urls.host(u).alias("host"), urls.site(u).alias("site"), F.regexp_replace(F.regexp_replace(u, "#.*", ""), r"\?\z", "").alias("bare"), urls.canonical_website(u).alias("website"))


@query(r"SELECT page_id, CASE WHEN regexp_matches(b, '^[^?]*://[^/?]+/[^?]*/(\?.*)?$') THEN regexp_replace(b, '^([^?]*://[^/?]+/[^?]*?)/(\?.*)?$', '\1\2') ELSE b END AS canonical FROM (SELECT page_id, regexp_replace(regexp_replace(url || '/', '#.*', ''), '\?$', '') AS b FROM pages)")
def canonical_urls(spark, sf):
    return pages(spark, sf).select("page_id", urls.canonical(F.concat("url", F.lit("/"))).alias("canonical"))


@query("SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'empty' WHEN page_id % 5 = 1 THEN 'spaces' WHEN page_id % 5 = 2 THEN 'scheme' WHEN page_id % 5 = 3 THEN 'host' END AS reason FROM pages")
def address_rejections(spark, sf):
    x = F.when(F.col("page_id") % 5 == 0, "  ").when(F.col("page_id") % 5 == 1, F.concat(F.lit("a b "), "url")).when(F.col("page_id") % 5 == 2, F.concat(F.lit("ftp://h.com/"), "page_id")).when(F.col("page_id") % 5 == 3, "localhost").otherwise(F.col("url"))
    return pages(spark, sf).select("page_id", urls.rejection(x).alias("reason"))


@query(f"SELECT {SITE} AS site, count(*) AS pages, min(page_id) AS first_page FROM pages GROUP BY 1")
def site_rollup(spark, sf):
    return pages(spark, sf).groupBy(urls.site(F.col("url")).alias("site")).agg(F.count("*").alias("pages"), F.min("page_id").alias("first_page"))


@query("SELECT page_id, regexp_extract(html, '<html[^>]*? lang=\"([^\"]*)\"', 1) AS lang FROM pages")
def page_languages(spark, sf):
    return extract.page_language(pages(spark, sf)).select("page_id", "lang")


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'en-US' WHEN p_partkey % 3 = 1 THEN 'pt-BR' ELSE 'zh-Hans-CN' END AS tag FROM part")
def language_tags(spark, sf):
    raw = F.when(F.col("p_partkey") % 3 == 0, "en_us").when(F.col("p_partkey") % 3 == 1, " PT-br ").otherwise("zh_Hans_cn")
    return table(spark, sf, "part").select("p_partkey", tx.language_tag(raw).alias("tag"))


@query(f"SELECT page_id, pos, text FROM {q_tags('h1')}")
def page_headings(spark, sf):
    return long(extract.tag_texts(pages(spark, sf), "h1"), "pos").select("page_id", "pos", "text")


@query(f"SELECT page_id, pos, text FROM {q_tags('title')}")
def page_titles(spark, sf):
    return long(extract.tag_texts(pages(spark, sf), "title"), "pos").select("page_id", "pos", "text")


@query(f"SELECT page_id, min(pos) AS pos, text FROM {q_tags('li')} WHERE length(text) < 200 GROUP BY page_id, text")
def list_items(spark, sf):
    rows = extract.tag_texts(pages(spark, sf), "li").filter(F.length("text") < 200)
    return long(order.top(order.keep_first(rows, ["page_id", "text"], ["pos"]), ["page_id"], ["pos"], 120), "pos").select("page_id", "pos", "text")


_LINKS = f"""(SELECT page_id, url, pos - 1 AS pos, {q_decode('xs[pos]')} AS href FROM (SELECT page_id, url, xs, unnest(range(1, len(xs) + 1)) AS pos FROM (SELECT page_id, url, regexp_extract_all(html, '(?i)<a\\s[^>]*?href="([^"]*)"', 1) AS xs FROM pages)))"""


@query(f"SELECT page_id, pos, href, regexp_extract(url, '^([A-Za-z]+://[^/?#]+)', 1) || regexp_replace(href, '#.*', '') AS target, true AS same_site FROM {_LINKS}")
def page_links(spark, sf):
    return long(extract.links(pages(spark, sf)), "pos").select("page_id", "pos", "href", "target", "same_site")


@query("SELECT page_id, array_to_string(regexp_extract_all(html, '(?is)<style[^>]*>(.*?)</style>', 1), chr(10)) AS css FROM pages")
def inline_css(spark, sf):
    return extract.inline_css(pages(spark, sf)).select("page_id", "css")


@query(f"SELECT page_id, pos, CASE WHEN n = '' THEN 'no-letters' WHEN n IN ({q_list(NOISE_EXACT)}) THEN 'exact-match' WHEN regexp_matches(n, 'tion|heit') THEN 'banner-phrase' END AS reason FROM (SELECT page_id, pos, {q_collapse(chr(39) + chr(39))} || {q_collapse("regexp_replace(regexp_replace(regexp_replace(lower(text), '[(\\[][^)\\]]*[)\\]]', ' ', 'g'), '[^\\p{L}\\p{N}\\s]+', ' ', 'g'), '\\s+[0-9]+$', '')")} AS n FROM {q_tags('li')})")
def nav_noise(spark, sf):
    items = long(extract.tag_texts(pages(spark, sf), "li"), "pos")
    return items.select("page_id", "pos", tx.noise_reason(F.col("text"), NOISE_EXACT, NOISE_CONTAINS).alias("reason"))


_TYPES = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(hay, ' ({'|'.join(w)})s? ') THEN '{t}' END" for t, w in TYPES.items()) + "], lambda x: x IS NOT NULL)"
_CLASSED = f"""(SELECT page_id, url, pos, target, {_TYPES} AS types FROM (SELECT page_id, url, pos, target, ' ' || trim(regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(target, '^[A-Za-z]+://[^/]*', '')), '[-_/]+', ' ', 'g'), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g')) || ' ' AS hay FROM (SELECT page_id, url, pos, regexp_extract(url, '^([A-Za-z]+://[^/?#]+)', 1) || regexp_replace(href, '#.*', '') AS target FROM {_LINKS})))"""


def _typed_links(spark, sf):
    rows = extract.links(pages(spark, sf))
    return rows.select("page_id", "url", F.col("pos").alias("ord"), "target", discover.page_types(F.lit(""), F.col("target"), TYPES).alias("types"))


@query(f"SELECT page_id, pos AS ord, array_to_string(types, ',') AS types, coalesce(types[1], 'unknown') AS primary_type FROM {_CLASSED}")
def classify_links(spark, sf):
    return long(_typed_links(spark, sf), "ord").select("page_id", "ord", F.array_join("types", ",").alias("types"), discover.primary_type(F.col("types")).alias("primary_type"))


_PER_TYPE = f"""(SELECT page_id, page_type, target, pos, row_number() OVER (PARTITION BY page_id, page_type ORDER BY pos) AS place FROM (SELECT page_id, page_type, target, min(pos) AS pos FROM (SELECT page_id, unnest(types) AS page_type, target, pos FROM {_CLASSED}) GROUP BY page_id, page_type, target) QUALIFY place <= 2)"""


@query(f"SELECT page_id, page_type, target AS canon, place FROM {_PER_TYPE}")
def links_per_type(spark, sf):
    return discover.candidates_per_type(_typed_links(spark, sf), ["page_id"]).select("page_id", "page_type", "canon", "place")


@query(f"""SELECT page_id, canon, array_to_string(list_transform(list_sort(list(DISTINCT {{'p': prio, 't': page_type}})), lambda x: x.t), ',') AS page_types, row_number() OVER (PARTITION BY page_id ORDER BY min({{'p': prio, 'o': pos}}), canon) AS place FROM (SELECT page_id, target AS canon, page_type, pos, list_position(['about', 'services', 'contact', 'pricing', 'team', 'testimonials', 'faq', 'blog'], page_type) AS prio FROM {_PER_TYPE}) GROUP BY page_id, canon QUALIFY place <= 3""")
def page_budget(spark, sf):
    return discover.budget(discover.candidates_per_type(_typed_links(spark, sf), ["page_id"]), ["page_id"], 3).select("page_id", "canon", F.array_join("page_types", ",").alias("page_types"), "place")


def _theme_sources(spark, sf):
    p = pages(spark, sf)
    both = extract.tag_texts(p, "li").unionByName(extract.tag_texts(p, "h1").withColumn("pos", F.col("pos") - 1000))
    ranked = both.filter(F.length("text").between(4, 80)).select(urls.site(F.col("url")).alias("site"), F.struct("page_id", "pos").alias("ord"), F.col("text").alias("source"))
    return ranked


_THEMES = f"""
WITH s AS (SELECT {SITE} AS site, page_id, pos, text AS source FROM {q_tags('li')} UNION ALL SELECT {SITE}, page_id, pos - 1000, text FROM {q_tags('h1')}),
d AS (SELECT site, source, min({{'p': page_id, 'o': pos}}) AS ord FROM s WHERE length(source) BETWEEN 4 AND 80 GROUP BY site, source),
w AS (SELECT DISTINCT site, source, ord, unnest(regexp_split_to_array(regexp_replace(lower(source), '[^a-z0-9\\s-]', ' ', 'g'), '\\s+')) AS theme FROM d),
c AS (SELECT site, theme, count(*) AS mentions, list(source ORDER BY ord)[1:3] AS ex FROM w WHERE length(theme) >= 4 AND theme NOT IN ({q_list(di.STOPWORDS)}) GROUP BY site, theme HAVING count(*) >= 2)
SELECT site, theme, mentions, array_to_string(ex, ' | ') AS examples, row_number() OVER (PARTITION BY site ORDER BY mentions DESC, theme) AS place FROM c QUALIFY place <= 12
"""


@query(_THEMES)
def content_themes(spark, sf):
    t = resolve.themes(_theme_sources(spark, sf), ["site"], di.STOPWORDS)
    return t.select("site", "theme", "mentions", F.array_join("examples", " | ").alias("examples"), "place")


_CLAUSES = {"privacy": "Read our privacy policy before you write.", "terms": "These are the terms of service for all.", "disclaimer": "Results may vary from case to case.", "guarantee": "Every order has a money-back guarantee here.", "accessibility": "See the accessibility statement of this site.", "licensing": "We are insured and bonded in every state."}


@query("SELECT page_id, CASE page_id % 8 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(_CLAUSES)) + " END AS kind FROM pages WHERE page_id % 8 < 6")
def footer_clauses(spark, sf):
    foot = extract.tag_texts(pages(spark, sf), "footer")
    said = F.get(F.array(*[F.lit(f". {s}") for s in _CLAUSES.values()]), (F.col("page_id") % 8).cast("int"))
    return extract.clauses(foot.withColumn("text", F.concat("text", F.coalesce(said, F.lit("")))), ["page_id"]).select("page_id", "kind")


# ---- generated markup


def _esc(c):
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))


def _markup(spark, sf, name, key, html, read_as_trees=False):
    rows = table(spark, sf, name)
    dealt = rows.repartition(tasks(spark, rows.count()), key) if read_as_trees else rows
    return dealt.select(F.col(key).alias("page_id"), F.concat(F.lit("https://www.site"), key, F.lit(".example.com/")).alias("url"), html.alias("html"))


def _cat(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


_MONEY = "CAST(CAST(floor(p_retailprice) AS BIGINT) AS VARCHAR)"


@query(f"SELECT p_partkey AS page_id, p_name AS name, p_type AS description, '$' || {_MONEY} AS price, CASE WHEN p_partkey % 2 = 0 THEN '$9' || {_MONEY} END AS original_price, p_brand AS category FROM part")
def product_cards(spark, sf):
    c = F.col
    cents = F.floor("p_retailprice").cast("long").cast("string")
    # cards are read as trees, which costs far more than the bytes by which files are split
    html = _cat('<div class="product-card" data-category="', _esc(c("p_brand")), '"><h3>', _esc(c("p_name")), "</h3><p>", _esc(c("p_type")), "</p>", F.when(c("p_partkey") % 2 == 0, _cat("<s>$9", cents, "</s> ")).otherwise(""), "<span>$", cents, "</span></div>")
    rows = extract.explode_relation(_markup(spark, sf, "part", "p_partkey", html, True), dom.offerings)
    return order.keep_first(rows, ["page_id", "name"], ["tier", "pos"]).select("page_id", "name", "description", "price", "original_price", "category")


@query("SELECT s_suppkey AS page_id, 'Organization' AS kind, s_name AS name, 'a' || s_suppkey || ' Main St' AS address FROM supplier")
def jsonld_organizations(spark, sf):
    html = _cat('<html><head><script type="application/ld+json">{"@graph":[{"@type":["Organization"],"name":"', F.col("s_name"), '","address":"a', F.col("s_suppkey"), ' Main St"}]}</script><script type="application/ld+json">{broken</script></head></html>')
    rows = extract.explode_relation(_markup(spark, sf, "supplier", "s_suppkey", html), dom.json_ld)
    org = rows.filter(F.array_contains("types", "organization"))
    v = F.try_parse_json("node")
    return org.select("page_id", F.try_variant_get(v, "$['@type'][0]", "string").alias("kind"), F.try_variant_get(v, "$.name", "string").alias("name"), F.try_variant_get(v, "$.address", "string").alias("address"))


@query("SELECT s_suppkey AS page_id, 'og:site_name' AS name, s_name AS value, true AS graph FROM supplier UNION ALL SELECT s_suppkey, 'description', 'about ' || s_name, false FROM supplier")
def meta_tags(spark, sf):
    html = _cat('<meta property="OG:site_name" content="old"><meta property="og:site_name" content="', F.col("s_name"), '"><meta name="Description" content="about ', F.col("s_name"), '">')
    rows = extract.explode_relation(_markup(spark, sf, "supplier", "s_suppkey", html), dom.meta_tags)
    return order.keep_first(rows, ["page_id", "name"], [F.desc("pos")]).select("page_id", "name", "value", "graph")


@query("SELECT s_suppkey AS page_id, 'email' AS kind, 's' || s_suppkey || '@x.com' AS value FROM supplier UNION ALL SELECT s_suppkey, 'phone', '555-123-' || (1000 + s_suppkey % 9000) FROM supplier UNION ALL SELECT s_suppkey, 'address', s_suppkey || ' Elm Road' FROM supplier")
def contact_details(spark, sf):
    html = _cat('<a href="mailto:s', F.col("s_suppkey"), '@x.com?subject=a">write</a> or call 555-123-', 1000 + F.col("s_suppkey") % 9000, " <p>other@y.com</p><address>", F.col("s_suppkey"), " Elm Road</address>")
    rows = extract.explode_relation(_markup(spark, sf, "supplier", "s_suppkey", html), dom.contacts)
    return rows.select("page_id", "kind", "value")


@query("SELECT s_suppkey AS page_id, 'en-US' AS main, 'fr,de-DE' AS alternates FROM supplier")
def hreflang(spark, sf):
    html = F.lit('<html lang="en_us"><head><link rel="alternate" hreflang="fr" href="/fr"><link rel="alternate" hreflang="x-default" href="/"><link rel="alternate" hreflang="de_de" href="/de"><link rel="alternate" hreflang="en-US" href="/en"></head></html>')
    rows = extract.explode_relation(_markup(spark, sf, "supplier", "s_suppkey", html), dom.languages)
    tagged = rows.select("page_id", F.col("pos").alias("ord"), tx.language_tag(F.col("main")).alias("main"), F.transform("alternates", tx.language_tag).alias("alternates"))
    return resolve.languages(tagged, ["page_id"]).select("page_id", "main", F.array_join("alternates", ",").alias("alternates"))


@query("SELECT s_suppkey AS page_id, 'Call ' || s_suppkey AS label, 'tel' AS kind FROM supplier UNION ALL SELECT s_suppkey, 'Book now', 'booking' FROM supplier UNION ALL SELECT s_suppkey, 'Send it', 'form' FROM supplier UNION ALL SELECT s_suppkey, 'quote', 'form' FROM supplier")
def calls_to_action(spark, sf):
    html = _cat('<a href="tel:', F.col("s_suppkey"), '">Call ', F.col("s_suppkey"), '</a><a class="btn" href="https://calendly.com/x">Book now</a><button>Menu</button><form name="quote"><input type="submit" value="Send it"></form>')
    rows = extract.explode_relation(_markup(spark, sf, "supplier", "s_suppkey", html), dom.calls_to_action)
    return order.top(order.keep_first(rows, ["page_id", "kind", "label"], ["pos"]), ["page_id"], ["pos"], 25).select("page_id", "label", "kind")


@query("SELECT n_nationkey AS page_id, 'Who is ' || n_name || ' for?' AS question, 'It is for all of ' || n_name || '.' AS answer FROM nation UNION ALL SELECT n_nationkey, 'Where is ' || n_name || '?', 'Look at a map of ' || n_name || ' first.' FROM nation")
def faq_entries(spark, sf):
    html = _cat("<details><summary>Who is ", F.col("n_name"), " for?</summary>It is for all of ", F.col("n_name"), ".</details><h3>Where is ", F.col("n_name"), "?</h3><p>Look at a map of ", F.col("n_name"), " first.</p><h3>Other</h3>")
    rows = extract.explode_relation(_markup(spark, sf, "nation", "n_nationkey", html), dom.questions)
    kept = order.keep_first(rows.withColumn("k", F.lower("question")), ["page_id", "k"], ["tier", "pos"])
    return kept.select(F.col("page_id").cast("int").alias("page_id"), "question", "answer")


@query("SELECT c_custkey AS page_id, 'They did good work for ' || c_name AS quote, c_name AS attributed_to FROM customer")
def testimonials(spark, sf):
    html = _cat("<blockquote>“They did good work for ", F.col("c_name"), "”<cite>— ", F.col("c_name"), "</cite></blockquote><blockquote>too short</blockquote>")
    rows = extract.explode_relation(_markup(spark, sf, "customer", "c_custkey", html), dom.testimonials)
    return rows.select("page_id", "quote", "attributed_to")


@query("SELECT s_suppkey AS page_id, '/logo' || s_suppkey || '.png' AS logo, s_name AS alt, 'img-logo' AS via FROM supplier UNION ALL SELECT s_suppkey, '/icon.ico', NULL, 'icon' FROM supplier")
def logos(spark, sf):
    html = _cat('<header><img class="site-logo" alt="', F.col("s_name"), '" src="/logo', F.col("s_suppkey"), '.png"></header><link rel="icon" href="/icon.ico"><img src="/hero.png">')
    rows = extract.explode_relation(_markup(spark, sf, "supplier", "s_suppkey", html).withColumnRenamed("url", "page_url").withColumn("url", F.lit("")), dom.logos).toDF("page_id", "page_url", "pos", "logo", "alt", "via", "tier")
    return order.top(order.keep_first(rows, ["page_id", "logo"], ["tier", "pos"]), ["page_id"], ["tier", "pos"], 5).select("page_id", "logo", "alt", "via")


@query("SELECT s_suppkey AS page_id, CASE WHEN s_suppkey % 2 = 0 THEN 'Facebook' ELSE 'YouTube' END AS platform FROM supplier")
def social_links(spark, sf):
    html = _cat('<a href="', F.when(F.col("s_suppkey") % 2 == 0, "https://www.facebook.com/s").otherwise("https://m.youtube.com/s"), F.col("s_suppkey"), '">x</a><a href="https://notfacebook.com/y">y</a>')
    rows = extract.links(_markup(spark, sf, "supplier", "s_suppkey", html)).withColumn("host", urls.host(F.col("target")))
    return extract.match_hosts(rows, "host", domains(spark, di.SOCIAL_DOMAINS), ["page_id", "pos"]).select("page_id", F.col("label").alias("platform"))


@query("SELECT s_suppkey AS page_id, 'Stripe' AS name, 'stripe.com' AS domain, 'script' AS via FROM supplier UNION ALL SELECT s_suppkey, 'Intercom', 'intercom.io', 'inline' FROM supplier")
def vendor_partners(spark, sf):
    html = F.lit('<script src="https://js.stripe.com/v3"></script><script>load("https://widget.intercom.io/w")</script><p>paypal.com in text</p>')
    return extract.vendors(_markup(spark, sf, "supplier", "s_suppkey", html), di.VENDORS)


@query("SELECT n_nationkey AS page_id, n_name || ' Smith' AS name, 'Founder' AS title, 'Female' AS gender FROM nation")
def team_members(spark, sf):
    html = _cat('<div class="team-member"><h3>', F.col("n_name"), ' Smith</h3><span class="role">Founder</span><p>She has led her team for a long time now.</p></div>')
    rows = extract.explode_relation(_markup(spark, sf, "nation", "n_nationkey", html), dom.people)
    kept = order.keep_first(rows, ["page_id", "name", "title"], ["tier", "pos"])
    return kept.select(F.col("page_id").cast("int").alias("page_id"), "name", "title", resolve.gender(F.col("pronouns")).alias("gender"))


@query("SELECT p_partkey AS page_id, 1 AS color_place, '#' || lower(printf('%06x', p_partkey * 37 + 1118481)) AS color, 2 AS n FROM part WHERE false UNION ALL SELECT p_partkey, 1, '#' || printf('%06x', p_partkey * 37 + 1193046), 2 FROM part UNION ALL SELECT p_partkey, 2, '#aabbcc', 1 FROM part")
def css_colors(spark, sf):
    hexa = F.lower(F.hex(F.col("p_partkey") * 37 + 1193046))
    css = _cat("a{color:#abc}p{color:#", hexa, ";background:#FFF;border-color:#", F.upper(hexa), "}")
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("page_id"), css.alias("css"))
    c = extract.colors(rows, ["page_id"])
    return c.select("page_id", F.col("place").cast("int").alias("color_place"), "color", F.col("n").cast("int").alias("n"))


@query("SELECT p_partkey AS page_id, 'Open Sans-B' AS font, 2 AS n, 1 AS place FROM part UNION ALL SELECT p_partkey, 'Brand' || p_size, 1, 2 FROM part")
def css_fonts(spark, sf):
    css = _cat("a{font-family:'Open Sans-b', serif}h1{font-family: \"Brand", F.col("p_size"), "\", Arial}p{font-family:open sans-b}")
    c = extract.fonts(table(spark, sf, "part").select(F.col("p_partkey").alias("page_id"), css.alias("css")), ["page_id"])
    return c.select("page_id", "font", F.col("n").cast("int").alias("n"), F.col("place").cast("int").alias("place"))


@query("SELECT s_suppkey AS id, 1 AS place, 'https://x.com/page-' || s_suppkey || '.xml' AS loc FROM supplier UNION ALL SELECT s_suppkey, 2, 'https://x.com/collections.xml?a=1&b=2' FROM supplier UNION ALL SELECT s_suppkey, 3, 'https://x.com/misc.xml' FROM supplier")
def sitemap_children(spark, sf):
    xml = _cat("<sitemapindex><sitemap><loc>https://x.com/products.xml</loc></sitemap><loc> https://x.com/misc.xml </loc><loc><![CDATA[https://x.com/page-", F.col("s_suppkey"), ".xml]]></loc><loc>https://x.com/collections.xml?a=1&amp;b=2</loc><loc>https://x.com/home</loc><loc></loc></sitemapindex>")
    locs = extract.sitemap_urls(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), xml.alias("xml")))
    return extract.child_sitemaps(locs).select("id", F.col("place").cast("int").alias("place"), "loc")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'ACME Corp certified to ISO' WHEN c_custkey % 3 = 1 THEN 'Member Board accredited since 2011' END AS name, CASE WHEN c_custkey % 3 = 1 THEN '2011' END AS year FROM customer WHERE c_custkey % 3 < 2")
def certifications(spark, sf):
    t = F.when(F.col("c_custkey") % 3 == 0, "We are ACME Corp certified to ISO. Licensed and insured.").when(F.col("c_custkey") % 3 == 1, "A Member Board accredited since 2011!").otherwise("certified work you can trust")
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.regexp_replace(t, "^(We are |A )", "").alias("text"))
    return extract.credentials(rows, ["id"]).select("id", "name", F.col("year").cast("string").alias("year"))


@query("SELECT c_custkey AS id, CASE c_custkey % 6 WHEN 0 THEN '$1,500' WHEN 1 THEN 'from $45/hour' WHEN 2 THEN 'per project' WHEN 3 THEN 'free estimate for you' WHEN 4 THEN '€20.50' END AS price FROM customer")
def prices(spark, sf):
    t = F.element_at(F.array(*[F.lit(x) for x in ["It is $1,500 now.", "Rates from $45/hour", "Billed per project. Ask.", "free estimate for you; call", "costs €20.50 each", "we do good work"]]), (F.col("c_custkey") % 6 + 1).cast("int"))
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), tx.price_in(t, di.PRICING_MODELS).alias("price"))


@query("SELECT c_custkey AS id, CAST(CASE WHEN c_custkey % 4 = 0 THEN 1980 + c_custkey % 30 WHEN c_custkey % 4 = 1 THEN 2001 ELSE 1941 END AS INT) AS year, CASE WHEN c_custkey % 4 = 0 THEN '1941' WHEN c_custkey % 4 = 1 THEN '1941' ELSE '' END AS rejected FROM customer")
def founding_years(spark, sf):
    k = F.col("c_custkey")
    about = F.when(k % 4 == 0, _cat("The shop was founded in ", 1980 + k % 30, ".")).otherwise("We bake.")
    home = _cat(F.when(k % 4 == 1, "It all started back in 2001. ").otherwise(""), "Serving Texas since 1941. © 2024")
    t = table(spark, sf, "customer").select(k.alias("id"), F.explode(F.array(F.struct(F.lit("about").alias("source"), about.alias("text")), F.struct(F.lit("homepage").alias("source"), home.alias("text")))).alias("p")).select("id", "p.*")
    y = resolve.founding_year(extract.years(t, ["id", "source"], 2026), ["id"])
    return y.select("id", "year", F.concat_ws(",", F.transform("rejected", lambda x: x.cast("string"))).alias("rejected"))


# ---- snippets and phrases over documents


@query(f"SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE length(v) >= 12 AND contains(v, ' ')) AS substantive, count(*) FILTER (WHERE length(v) >= 150 AND regexp_matches(rtrim(text), '[\\p{{L}}\\p{{N}}]$')) AS truncated FROM (SELECT doc_id, text, {q_collapse('text')} AS v FROM {LINES}) GROUP BY doc_id")
def snippet_quality(spark, sf):
    t = F.col("text")
    return lines(spark, sf).groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(tx.substantive(t)).alias("substantive"), F.count_if(tx.truncated(t)).alias("truncated"))


@query(f"SELECT doc_id, pos, text FROM {LINES} WHERE regexp_matches(lower(text), 'license|the thing|wh the')")
def signal_snippets(spark, sf):
    return long(lines(spark, sf), "pos").filter(tx.any_phrase(F.col("text"), SIGNALS)).select("doc_id", "pos", "text")


@query(f"SELECT doc_id, place, pos, text FROM (SELECT doc_id, pos, text, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS place FROM {LINES} WHERE length(trim(text)) > 0 QUALIFY row_number() OVER (PARTITION BY doc_id, lower(text[1:160]) ORDER BY pos) = 1) WHERE false UNION ALL SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS place, pos, text FROM (SELECT * FROM {LINES} WHERE length(trim(text)) > 0 QUALIFY row_number() OVER (PARTITION BY doc_id, lower(text[1:160]) ORDER BY pos) = 1) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY pos) <= 3")
def snippet_bundles(spark, sf):
    return order.bundle(long(lines(spark, sf), "pos"), ["doc_id"], "text", ["pos"], 3).select("doc_id", "place", "pos", "text")


@query("SELECT lang, place, doc_id, source FROM (SELECT lang, doc_id, source, row_number() OVER (PARTITION BY lang ORDER BY turn, seat) AS place FROM (SELECT lang, doc_id, source, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS turn, min(doc_id) OVER (PARTITION BY lang, source) AS seat FROM documents)) WHERE place <= 30")
def round_robin_sources(spark, sf):
    return order.round_robin(table(spark, sf, "documents").select("lang", "doc_id", "source"), ["lang"], "source", ["doc_id"], 30).select("lang", "place", "doc_id", "source")


@query("SELECT lang, min(place) AS place, source FROM (SELECT lang, source, row_number() OVER (PARTITION BY lang ORDER BY turn, tier) AS place FROM (SELECT lang, source, doc_id % 3 AS tier, row_number() OVER (PARTITION BY lang, doc_id % 3 ORDER BY doc_id) AS turn FROM documents)) WHERE place <= 30 GROUP BY lang, source")
def interleaved_tiers(spark, sf):
    d = table(spark, sf, "documents").select("lang", "source", "doc_id", (F.col("doc_id") % 3).alias("tier"))
    return order.interleave(d, ["lang"], "tier", ["doc_id"], 30, ["source"]).select("lang", "place", "source")


@query("SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY lower(text[1:160]) ORDER BY doc_id) = 1")
def keep_first_prefix(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.lower(F.substring("text", 1, 160)).alias("head"))
    return order.keep_first(d, ["head"], ["doc_id"]).select("doc_id")


@query(f"SELECT lang, source AS value, count(*) AS n, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, min(doc_id)) AS place FROM documents GROUP BY lang, source QUALIFY place <= 5")
def rank_by_frequency(spark, sf):
    return order.by_frequency(table(spark, sf, "documents").select("lang", "doc_id", F.col("source").alias("value")), ["lang"], "value", ["doc_id"], 5)


@query("SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)*\\.[A-Za-z]{2,}')) AS email FROM documents")
def emails(spark, sf):
    return extract.emails(table(spark, sf, "documents").select("doc_id", "text"), ["doc_id"], 1 << 30).select("doc_id", "email")


_HITS = "list_filter([" + ", ".join(f"CASE WHEN contains(lower(text), '{p}') THEN '{p}' END" for p in PHRASES) + "], lambda x: x IS NOT NULL)[1:3]"


@query(f"SELECT doc_id, nullif(array_to_string({_HITS}, ', '), '') AS phrases FROM documents")
def phrase_rollup(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.roll_up(F.col("text"), PHRASES).alias("phrases"))


@query("SELECT doc_id, CASE WHEN contains(lower(text), 'licensed under') THEN 'Licensor' WHEN contains(lower(text), 'released under') THEN 'Publisher' WHEN contains(lower(text), 'the and') OR contains(lower(text), 'de la') THEN 'Speaker' END AS role FROM documents")
def role_first_match(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.first_label(F.col("text"), ROLES).alias("role"))


@query(f"SELECT doc_id, {q_collapse('text')} AS collapsed, md5(trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '[-_/]+', ' ', 'g'), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g'))) AS form FROM documents")
def text_forms(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", tx.collapse(t).alias("collapsed"), F.md5(tx.match_form(t)).alias("form"))


@query("SELECT doc_id, list_filter([CASE WHEN bool_or(regexp_matches(text, '(?i)licen')) THEN 'Licences' END, CASE WHEN bool_or(contains(text, '@')) THEN 'Contact' END, CASE WHEN bool_or(length(text) > 2000) THEN 'Long reads' END], lambda x: x IS NOT NULL)::VARCHAR AS labels FROM documents GROUP BY doc_id")
def funnel_rules(spark, sf):
    t = F.col("text")
    e = resolve.evidence(table(spark, sf, "documents"), ["doc_id"], {"Licences": t.rlike("(?i)licen"), "Contact": F.contains(t, F.lit("@")), "Long reads": F.length(t) > 2000})
    return e.select("doc_id", F.concat(F.lit("["), F.array_join("labels", ", "), F.lit("]")).alias("labels"))


@query("SELECT user_id, array_to_string(list_filter([CASE WHEN bool_or(event_type = 'signup') THEN 'Online (website forms)' END, CASE WHEN bool_or(event_type = 'click') THEN 'Phone' END, CASE WHEN bool_or(event_type = 'view') THEN 'Email' END, CASE WHEN bool_or(event_type = 'purchase') THEN 'Online ordering / e-commerce' END], lambda x: x IS NOT NULL), '; ') AS channels FROM events GROUP BY user_id")
def channels(spark, sf):
    kinds = {"cta_form": "signup", "phone": "click", "email": "view", "commerce": "purchase"}
    flags = {label: F.col("event_type") == kinds[k] for label, k in resolve.CHANNELS.items() if k in kinds}
    return resolve.evidence(table(spark, sf, "events"), ["user_id"], flags).select("user_id", F.array_join("labels", "; ").alias("channels"))


@query(f"SELECT doc_id, pos, CASE WHEN v = '' THEN 'not-visible' WHEN NOT regexp_matches(v, '[\\p{{L}}\\p{{N}}]') THEN 'no-letters' WHEN length(v) <= 2 THEN 'too-short' WHEN length(v) >= 60 THEN 'too-long' WHEN row_number() OVER (PARTITION BY doc_id, v ORDER BY pos) > 1 THEN 'duplicate' ELSE 'kept' END AS verdict FROM (SELECT doc_id, pos, {q_collapse('text')} AS v FROM {LINES})")
def grouping_verdicts(spark, sf):
    rows = long(lines(spark, sf), "pos").withColumnRenamed("pos", "ord")
    return resolve.grouping_verdicts(rows, ["doc_id"]).select("doc_id", F.col("ord").alias("pos"), "verdict")


_KIND = "CASE pos % 4 WHEN 0 THEN 'hero' WHEN 1 THEN 'homepage' WHEN 2 THEN 'declared' ELSE 'about' END"
for _field, _order in resolve.POSITIONING.items():
    _r = "CASE WHEN kind = 'declared' AND length(rtrim(text)) >= 150 AND regexp_matches(rtrim(text), '[\\p{L}\\p{N}]$') THEN 9 ELSE list_position([" + q_list(_order) + "], kind) END"

    def _positioning(spark, sf, field=_field):
        kind = F.element_at(F.array(*[F.lit(k) for k in ("hero", "homepage", "declared", "about")]), F.col("pos") % 4 + 1)
        pool = lines(spark, sf).select("doc_id", kind.alias("kind"), F.col("pos").alias("ord"), "text")
        return long(resolve.positioning(pool, ["doc_id"], field), "ord").select("doc_id", "place", "kind", "ord")

    QUERIES[f"positioning_{_field}"] = _positioning
    ORACLES[f"positioning_{_field}"] = f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY {_r}, ord) AS place, kind, ord FROM (SELECT doc_id, {_KIND} AS kind, pos AS ord, text FROM {LINES}) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY {_r}, ord) <= 3"


@query(f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY level, ord) AS place, text FROM (SELECT doc_id, text, level, ord FROM (SELECT doc_id, text, pos % 4 + 1 AS level, pos AS ord FROM {LINES}) WHERE level <= 3 AND contains({q_collapse('text')}, ' ') QUALIFY row_number() OVER (PARTITION BY doc_id, text ORDER BY level, ord) = 1) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY level, ord) <= 4")
def voice_headings(spark, sf):
    rows = lines(spark, sf).select("doc_id", "text", (F.col("pos") % 4 + 1).alias("level"), F.col("pos").alias("ord"))
    return resolve.voice_headings(rows, ["doc_id"]).select("doc_id", "place", "text")


@query(f"SELECT doc_id, pos, heading_at FROM (SELECT doc_id, pos, text, last_value(CASE WHEN length(text) < 40 THEN pos END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS heading_at FROM {LINES}) WHERE length(text) >= 40 AND pos - heading_at <= 3")
def sibling_walk(spark, sf):
    rows = long(lines(spark, sf), "pos")
    return order.walk(rows, ["doc_id"], "pos", F.length("text") < 40, 3).select("doc_id", "pos", "heading_at")


@query("WITH s AS (SELECT doc_id, string_split(text, ' ') AS e FROM documents) SELECT doc_id, len(e) >= 25 OR (len(e) >= 4 AND n >= 4 AND 2 * n >= len(e)) AS is_options FROM (SELECT doc_id, e, len(list_filter(e, lambda x: regexp_matches(x, '\\b[A-Z]{3}\\b'))) AS n FROM s)")
def option_lists(spark, sf):
    return table(spark, sf, "documents").select("doc_id", resolve.option_list(F.split("text", " ")).alias("is_options"))


@query("SELECT p_brand, p_type AS industry, n FROM (SELECT p_brand, p_type, count(*) AS n, min(p_partkey) AS f, count(*) OVER (PARTITION BY p_brand) AS kinds FROM part GROUP BY p_brand, p_type) WHERE n >= 2 OR kinds = 1 QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, f) = 1")
def industry_mode(spark, sf):
    rows = table(spark, sf, "part").select("p_brand", F.col("p_partkey").alias("ord"), F.col("p_type").alias("category"))
    return resolve.industry(rows, ["p_brand"], di.GENERIC_CATEGORIES)


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'LLC' WHEN 1 THEN 'Inc.' WHEN 2 THEN 'GmbH' END AS suffix FROM customer")
def legal_suffixes(spark, sf):
    name = F.concat("c_name", F.element_at(F.array(*[F.lit(x) for x in (" LLC", " inc.", " GmbH", " shop")]), (F.col("c_custkey") % 4 + 1).cast("int")))
    return table(spark, sf, "customer").select("c_custkey", resolve.legal_suffix(name, di.LEGAL_SUFFIXES).alias("suffix"))


@query("SELECT p_partkey AS page_id, p_name AS name FROM part WHERE p_partkey % 2 = 1 AND p_partkey % 5 <> 0")
def people_not_offers(spark, sf):
    p = table(spark, sf, "part")
    people = p.select(F.col("p_partkey").alias("page_id"), F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 5 == 0, "Regular price $5. Add to cart").otherwise("leads the team").alias("bio"))
    offers = p.filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("page_id"), F.upper(F.concat(F.lit(" "), "p_name")).alias("name"))
    return resolve.people_not_offers(people, offers, ["page_id"], di.OFFERING_SIGNALS).select("page_id", "name")


@query("SELECT s_suppkey, coalesce(n_name, 'none') AS alt FROM supplier LEFT JOIN (SELECT n_nationkey, n_name FROM nation WHERE n_nationkey % 2 = 0) ON s_nationkey = n_nationkey")
def logo_alts(spark, sf):
    alts = table(spark, sf, "nation").filter("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return table(spark, sf, "supplier").join(alts, "s_nationkey", "left").select("s_suppkey", F.coalesce("n_name", F.lit("none")).alias("alt"))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN CASE event_id % 4 WHEN 0 THEN 'timeout' WHEN 1 THEN 'dns' WHEN 2 THEN 'connection-refused' ELSE 'blocked' END WHEN event_id % 3 = 0 THEN 'blocked' WHEN event_id % 3 = 1 THEN 'http-error' END AS reason FROM events")
def fetch_failures(spark, sf):
    k = F.col("event_id")
    code = F.when(F.col("event_type") == "error", F.element_at(F.array(*[F.lit(x) for x in ("ETIMEDOUT", "ENOTFOUND", "ECONNRESET", "CERT_HAS_EXPIRED")]), (k % 4 + 1).cast("int")))
    return table(spark, sf, "events").select("event_id", discover.failure(F.when(k % 3 == 0, 403).when(k % 3 == 1, 500).otherwise(200), code).alias("reason"))


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN true ELSE false END AS missing FROM pages")
def soft_404(spark, sf):
    k = F.col("page_id")
    home = F.concat(F.lit("<title>Home</title>"), "html")
    body = F.when(k % 4 == 0, F.lit(" ")).when(k % 4 == 1, home).when(k % 4 == 2, F.lit("<title>Page not found</title>")).otherwise(F.concat(F.lit("<title>Other</title>"), "html", "html"))
    return pages(spark, sf).select("page_id", discover.soft_404(body, home).alias("missing"))


# ---- repository over customers and orders


def _kbs(spark, sf):
    o = table(spark, sf, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "deleted").otherwise("active")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("company_id"), F.col("o_orderdate").alias("created_at"), F.col("o_orderkey").alias("seq"), status.alias("status"), F.col("o_orderpriority").alias("industry"), F.array(F.col("o_orderstatus"), F.lit("en")).alias("languages"))


_KB = "(SELECT o_orderkey AS id, o_custkey AS company_id, o_orderdate AS created_at, CASE WHEN o_orderstatus = 'F' THEN 'deleted' ELSE 'active' END AS status, o_orderpriority AS industry, o_orderstatus AS lang, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS version_no FROM orders)"


@query(f"SELECT id, company_id, version_no FROM {_KB} WHERE version_no <= 5")
def retention(spark, sf):
    return repository.retain(_kbs(spark, sf)).select("id", "company_id", "version_no")


@query(f"SELECT id, company_id FROM {_KB} WHERE version_no = 1")
def current_versions(spark, sf):
    return repository.current(_kbs(spark, sf)).select("id", "company_id")


@query(f"SELECT id, company_id, version_no FROM {_KB} WHERE version_no > 1")
def older_versions(spark, sf):
    return repository.versions(_kbs(spark, sf)).select("id", "company_id", "version_no")


def _current(spark, sf):
    return repository.current(_kbs(spark, sf)).withColumn("is_current", F.lit(True))


@query(f"SELECT id, company_id FROM {_KB} k JOIN customer ON company_id = c_custkey WHERE version_no = 1 AND status = 'active' AND industry = '1-URGENT' AND contains(lower(c_name), '00')")
def list_filter(spark, sf):
    named = _current(spark, sf).join(table(spark, sf, "customer").select(F.col("c_custkey").alias("company_id"), F.col("c_name").alias("name")), "company_id")
    return repository.listing(named, industry="1-URGENT", language="en", search=" 00 ").select("id", "company_id")


@query(f"SELECT DISTINCT kind, value FROM (SELECT 'industry' AS kind, industry AS value FROM {_KB} WHERE version_no = 1 UNION ALL SELECT 'language', lang FROM {_KB} WHERE version_no = 1 UNION ALL SELECT 'language', 'en')")
def facets(spark, sf):
    return repository.facets(_current(spark, sf))


@query(f"SELECT id, CASE WHEN id % 7 = 0 THEN 'deleted' ELSE status END AS status FROM {_KB} WHERE version_no = 1")
def soft_delete(spark, sf):
    kbs = _current(spark, sf).withColumn("updated_at", F.col("created_at"))
    ids = table(spark, sf, "orders").filter("o_orderkey % 7 = 0").select(F.col("o_orderkey").alias("id"))
    return repository.set_status(kbs, ids, "deleted", F.lit("2026-01-01").cast("timestamp_ntz")).select("id", "status")


@query(f"SELECT count(DISTINCT company_id) AS companies, count(*) AS snapshots FROM {_KB} WHERE id % 3 <> 0")
def hard_delete(spark, sf):
    kbs = _kbs(spark, sf)
    ids = kbs.filter("id % 3 = 0").select("id")
    companies = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    sections = kbs.select(F.col("id").alias("kb_id"), F.lit("people").alias("section"))
    c, k, _ = repository.hard_delete(companies, kbs, sections, ids)
    return c.agg(F.count("*").alias("companies")).join(k.agg(F.count("*").alias("snapshots")))


@query("SELECT 'https://c' || c_custkey || '.example.com' AS canonical_website, CASE WHEN c_custkey % 3 = 0 THEN 'new ' || c_name ELSE c_name END AS name FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0")
def upsert_companies(spark, sf):
    c = table(spark, sf, "customer")
    old = c.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), _cat("https://c", F.col("c_custkey"), ".example.com").alias("canonical_website"))
    new = c.filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"), _cat("new ", F.col("c_name")).alias("name"), _cat("HTTPS://www.C", F.col("c_custkey"), ".example.com/x").alias("website"))
    return repository.upsert_companies(old, new).select("canonical_website", "name")


@query("SELECT company_id, count(*) AS kept, max(CASE WHEN is_current THEN id END) AS current_id FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY created_at DESC, seq DESC) AS rn FROM (SELECT o_orderkey AS id, o_custkey AS company_id, o_orderdate AS created_at, o_orderkey AS seq, false AS is_current FROM orders UNION ALL SELECT c_custkey + 10000000, c_custkey, TIMESTAMP '2030-01-01', 0, true FROM customer)) WHERE rn <= 5 GROUP BY company_id")
def save_snapshots(spark, sf):
    old = _kbs(spark, sf).select("id", "company_id", "created_at", "seq").withColumn("is_current", F.lit(True))
    new = table(spark, sf, "customer").select((F.col("c_custkey") + 10_000_000).alias("id"), F.col("c_custkey").alias("company_id"), F.lit("2030-01-01").cast("timestamp_ntz").alias("created_at"), F.lit(0).cast("long").alias("seq"))
    out = repository.save(old, new)
    return out.groupBy("company_id").agg(F.count("*").alias("kept"), F.max(F.when(F.col("is_current"), F.col("id"))).alias("current_id"))


@query("SELECT n_nationkey AS kb_id, 'people' AS section, n_nationkey % 3 = 0 AS hidden, CASE WHEN n_nationkey % 3 = 0 THEN '2' END AS hidden_at FROM nation WHERE n_nationkey % 3 < 2 UNION ALL SELECT n_nationkey, 'people', true, '1' FROM nation WHERE n_nationkey % 3 = 2")
def section_states(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("kb_id"), F.lit("people").alias("section"))
    old = n.select("*", F.lit(True).alias("hidden"), F.lit("1").alias("hidden_at"))
    new = n.filter("kb_id % 3 < 2").select("*", (F.col("kb_id") % 3 == 0).alias("hidden"), F.lit("2").alias("hidden_at"))
    return repository.set_sections(old, new)


@query("SELECT c_custkey, '[{\"name\":\"' || c_name || '\"}]' AS people FROM customer WHERE regexp_matches(c_name, '(?i)CUSTOMER#0+1')")
def people_search(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.array(F.struct(F.col("c_name").alias("name"))).alias("people"))
    return repository.people_named(c, "people", "CUSTOMER#0+1").select("c_custkey", F.to_json("people").alias("people"))


@query("SELECT c_custkey, trim(regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g'), '-') || '.json' AS file FROM customer")
def export_names(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", export_name(F.col("c_name")).alias("file"))


# ---- validation and review

_FIELDS = [registry.Field("overview", "foundation", 2, "longText", True), registry.Field("lang", "foundation", 1, "text"), registry.Field("n_chars", "market", 1, "number"), registry.Field("tags", "people", 3, "stringList"), registry.Field("offers", "offerings", 3, "objectList", True, ("name", "price"))]


def _drafts(spark, sf):
    d = table(spark, sf, "documents")
    k = F.col("doc_id")
    return d.select(
        "doc_id", F.struct(F.when(k % 3 == 0, "absent").otherwise("found").alias("status")).alias("overview"), F.when(k % 4 == 0, " ").otherwise(F.col("lang")).alias("lang"), F.when(k % 5 > 0, F.col("n_chars")).alias("n_chars"),
        F.when(k % 2 == 0, F.array(F.lit(" "), F.lit(""))).otherwise(F.array(F.lit(" a "), F.lit(""))).alias("tags"),
        F.array(F.struct(F.when(k % 7 > 0, F.lit("x")).alias("name"), F.lit(None).cast("string").alias("price"), F.lit("src").alias("source_url"))).alias("offers"),
        F.when(k % 11 == 0, F.array(F.lit("people"))).otherwise(F.array().cast("array<string>")).alias("hidden"),
    )


_FILLED = "CAST(doc_id % 3 <> 0 AS INT) + CAST(doc_id % 4 <> 0 AS INT) + CAST(doc_id % 5 <> 0 AND n_chars IS NOT NULL AS INT) + CAST(doc_id % 2 = 1 AND doc_id % 11 <> 0 AS INT) + CAST(doc_id % 7 <> 0 AS INT)"


@query(f"SELECT doc_id, CAST(floor(100.0 * p / c + 0.5) AS BIGINT) AS score, CAST(p AS BIGINT) AS populated, CAST(c AS BIGINT) AS counted, CAST(5 - c AS BIGINT) AS hidden_count FROM (SELECT doc_id, {_FILLED} AS p, CASE WHEN doc_id % 11 = 0 THEN 4 ELSE 5 END AS c FROM documents)")
def completeness(spark, sf):
    return registry.completeness(_drafts(spark, sf), _FIELDS, ["doc_id"]).drop("missing")


@query("SELECT doc_id, array_to_string(list_filter([CASE WHEN doc_id % 3 = 0 THEN 'overview:not-found' END, CASE WHEN doc_id % 4 = 0 THEN 'lang:not-found' END, CASE WHEN doc_id % 5 = 0 OR n_chars IS NULL THEN 'n_chars:not-found' END, CASE WHEN doc_id % 11 = 0 THEN 'tags:hidden' WHEN doc_id % 2 = 0 THEN 'tags:not-found' END, CASE WHEN doc_id % 7 = 0 THEN 'offers:not-found' END], lambda x: x IS NOT NULL), ',') AS missing FROM documents")
def missing_fields(spark, sf):
    c = registry.completeness(_drafts(spark, sf), _FIELDS, ["doc_id"])
    return c.select("doc_id", F.array_join(F.transform("missing", lambda m: F.concat_ws(":", m["path"], m["reason"])), ",").alias("missing"))


@query("SELECT doc_id, CAST(CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 1 END AS BIGINT) AS tags, CAST(CASE WHEN doc_id % 7 = 0 THEN 0 ELSE 1 END AS BIGINT) AS offers, CAST(CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS BIGINT) AS removed FROM documents")
def pruned_entries(spark, sf):
    p = registry.prune(_drafts(spark, sf), _FIELDS)
    return p.select("doc_id", F.size("tags").cast("long").alias("tags"), F.size("offers").cast("long").alias("offers"), F.aggregate("pruned", F.lit(0).cast("long"), lambda a, g: a + g["removed"]).alias("removed"))


@query("SELECT doc_id, doc_id % 5 IN (1, 3) AS reviewed, CASE doc_id % 5 WHEN 0 THEN 'unreviewed' WHEN 1 THEN NULL WHEN 2 THEN 'unreviewed' WHEN 3 THEN 'empty' ELSE 'absent-and-empty' END AS problem FROM documents")
def review_states(spark, sf):
    k = F.col("doc_id") % 5
    status = F.when(k == 4, "absent").otherwise("found")
    ph = registry.placeholder(F.lit("Overview"), status, F.lit(2))
    value = F.when(k == 0, ph).when(k == 1, "written").when(k == 2, "[MOCK other]").otherwise("")
    rev = registry.is_reviewed(value, ph)
    return table(spark, sf, "documents").select("doc_id", rev.alias("reviewed"), registry.resolve_text(value, rev, status).alias("problem"))


@query("SELECT conv_id, CASE WHEN n = 0 OR conv_id % 3 = 0 THEN 'insufficient_data' ELSE 'partial' END AS alignment, CASE WHEN n = 0 OR conv_id % 3 = 0 THEN 'high' ELSE 'low' END AS confidence FROM (SELECT conv_id, count(*) FILTER (WHERE role = 'assistant') AS n FROM conversations GROUP BY conv_id)")
def persona_fit(spark, sf):
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.count_if(F.col("role") == "assistant").alias("n"))
    a, b = registry.persona_fit(F.col("n"), F.when(F.col("conv_id") % 3 == 0, " ").otherwise("a person"))
    return c.select("conv_id", a.alias("alignment"), b.alias("confidence"))


@query("SELECT user_id, array_to_string(list_filter([CASE WHEN user_id % 2 = 0 THEN 'partial' END, CASE WHEN user_id % 3 = 0 THEN 'year-conflict' END, CASE WHEN user_id % 5 = 0 THEN 'sitemap-fallback' END, CASE WHEN count(*) = 1 THEN 'one-page' END], lambda x: x IS NOT NULL), ',') AS warnings FROM events GROUP BY user_id")
def scan_warnings(spark, sf):
    u = F.col("user_id")
    s = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("pages")).select("user_id", "pages", F.when(u % 2 == 0, "partial").otherwise("complete").alias("status"), (u % 3 == 0).alias("year_conflict"), F.lit(False).alias("nav_unusable"), F.when(u % 5 == 0, 1).otherwise(0).alias("sitemap_types"), F.lit(0).alias("probed_types"), F.lit(0).alias("unmatched_types"))
    return s.select("user_id", F.array_join(discover.warnings(s), ",").alias("warnings"))


# ---- progress events


@query("SELECT user_id, max_by(event_type, event_id) AS stage, CAST(max_by(event_id, event_id) AS INT) AS completed, count(*) FILTER (WHERE event_type = 'error') AS failures, bool_or(event_type = 'purchase') AS done FROM events GROUP BY user_id")
def progress_fold(spark, sf):
    e = table(spark, sf, "events")
    kind = F.when(F.col("event_type") == "error", "page-failed").when(F.col("event_type") == "purchase", "done").otherwise("page")
    rows = e.select(kind.alias("type"), F.col("user_id").cast("string").alias("scan_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("stage"), F.lit(None).cast("string").alias("message"), F.col("event_id").cast("int").alias("completed"), F.lit(None).cast("int").alias("total"))
    back = event_lines(to_lines(rows).union(spark.createDataFrame([("",), ("{broken",)], "value string")))
    return progress.fold(back).select(F.col("scan_id").cast("long").alias("user_id"), "stage", "completed", "failures", "done")


@query("SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 60 MINUTE")
def cache_prune(spark, sf):
    e = table(spark, sf, "events").withColumn("stored_at", F.col("ts"))
    now = e.agg(F.max("ts").alias("now"))
    return prune_cache(e.join(F.broadcast(now)), F.col("now")).select("event_id")  # one row


@query("SELECT user_id AS scan_id, event_id AS url, CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'retried' ELSE 'stored' END AS origin FROM events WHERE event_type <> 'error' OR event_id % 2 = 0")
def retry_merge(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("scan_id"), F.col("event_id").alias("url"), "event_type")
    stored = e.filter("event_type <> 'error'").select("scan_id", "url", F.lit("stored").alias("origin"))
    failed = e.filter("event_type = 'error'").select("scan_id", "url")
    fetched = failed.filter("url % 2 = 0").select("*", F.lit("retried").alias("origin"))
    return progress.retry_merge(stored, fetched, failed)[0]


@query("SELECT user_id, CASE WHEN bool_or(event_type = 'error' AND (event_id % 2 = 0 OR user_id % 2 = 0)) THEN 'partial' ELSE 'complete' END AS status FROM events GROUP BY user_id")
def scan_status(spark, sf):
    e = table(spark, sf, "events")
    rows = e.select("user_id", F.when(F.col("event_type") == "error", F.when(F.col("event_id") % 2 == 0, "timeout").otherwise("dns")).alias("reason"), (F.col("user_id") % 2 == 0).alias("resumed"))
    return discover.scan_status(rows, ["user_id"])


@query("SELECT o_orderkey AS url FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 3)")
def unread_pages(spark, sf):
    planned = table(spark, sf, "orders").select(F.col("o_orderkey").alias("url"))
    return discover.unread(planned, table(spark, sf, "lineitem").filter("l_linenumber = 3").select(F.col("l_orderkey").alias("url")), ["url"])
