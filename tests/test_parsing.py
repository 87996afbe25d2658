"""The page's tree, its main content by scores, one parse for many relations, structured data over a site, and dictionaries in one pass."""

import json

import pytest
from pyspark.sql import functions as F

from pagequarry.functions import matcher
from pagequarry.operators import discover, dom, entities, parsed, readability, snippets, structured


def texts(html, *tags):
    return [n.text() for n in dom.parse(html).find(*tags)]


def test_implied_ends():
    assert texts("<p><b>one<br><p>two</p><p>three<ul><li>a<li>b<p>c</ul>", "p") == ["one", "two", "three", "c"]
    assert texts("<ul><li><b>a<li>b<ul><li>c</ul><li>d</ul>", "li") == ["a", "b c", "c", "d"]
    assert texts("<table><tr><td><i>a<td>b<tr><td>c</table>", "tr") == ["a b", "c"]
    assert texts("<table><tr><td><i>a<td>b<tr><td>c</table>", "td") == ["a", "b", "c"]
    assert texts("<p>x<button><p>y</button>z</p>", "p") == ["x yz", "y"]


LONG = "A first sentence, with commas, which is long enough to count as prose. Another one follows it, and a third, so that it is long."


def test_content_by_scores():
    page = f'<body><div class="sidebar"><p>{LONG}</p><p>{LONG}</p></div><div><div id="a"><p>{LONG}</p><p>{LONG}</p><p>Short.</p></div><p>It ends here.</p><p><a href=x>more</a></p></div><div class="comments"><p>{LONG}</p></div></body>'
    blocks, scored = readability.content(dom.parse(page))
    assert scored and blocks == [("p", LONG), ("p", LONG), ("p", "Short."), ("p", "It ends here.")]
    links = "".join(f"<p><a href=/{i}>{LONG}</a></p>" for i in range(9))
    blocks, scored = readability.content(dom.parse(f"<body><div>{links}</div><div>{LONG} {LONG}</div></body>"))
    assert scored and blocks[-1] == ("div", f"{LONG} {LONG}")  # a division without blocks is prose
    blocks, scored = readability.content(dom.parse(f"<body><div>{links}</div><div><p>{LONG}</p></div></body>"))
    assert scored and ("p", LONG) in blocks
    blocks, scored = readability.content(dom.parse(f'<body><div class="sidebar"><p>{LONG}</p><p>{LONG}</p></div><p>tiny</p></body>'))
    assert scored and ("p", LONG) in blocks  # too little without the furniture: once more with it
    assert readability.content(dom.parse("<main><p>Call us.</p></main>")) == ([("p", "Call us.")], False)
    assert readability.content(dom.parse("")) == ([], False) and readability.content(dom.parse("<p>" * 3000 + LONG))[0]


@pytest.fixture(scope="module")
def rows(spark):
    html = '<title>T</title><script type="application/ld+json">{"@type":"Person","name":"Ann Lee"}</script><h2>Red Shoe</h2><p>It is red, and it is a shoe.</p><div class="team-card"><h3>Red Shoe</h3><p>x</p></div><h3>Your cart is empty</h3><ul><li>One two three four</li><li>One two three four</li><li>​</li></ul><script>var hidden = 1</script>'
    pages = spark.createDataFrame([("s", 1, "homepage", html), ("s", 2, "about", None), ("s", 3, "about", "")], "site string, ord long, page_type string, html string")
    return parsed.parse(pages)


def test_one_parse_gives_all_relations(spark, rows, tmp_path):
    assert {r.relation for r in rows.select("relation").distinct().collect()} >= {"json_ld", "title", "heading", "item", "main", "person", "offer"}
    assert [r.name for r in parsed.of(rows, "person").collect()] == ["Ann Lee"]  # what names an offer is no person
    assert all("hidden" not in (r.text or "") for n in ("main", "item", "heading") for r in parsed.of(rows, n).collect())
    plan = rows.select("relation")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    parsed.write(rows, str(tmp_path / "rows"))
    assert [r.text for r in parsed.read(spark, str(tmp_path / "rows"), "title").collect()] == ["T"]
    one = parsed.read(spark, str(tmp_path / "rows"), "title")._jdf.queryExecution().executedPlan().toString()
    assert "main" not in one.split("ReadSchema")[1] and "PartitionFilters: [isnotnull(relation" in one


def test_snippets_are_visible_and_no_chrome(rows):
    got = [(r.kind, r.text) for r in snippets.blocks(rows).orderBy(*snippets.ORDER).collect()]
    assert ("heading", "Your cart is empty") not in got and got.count(("item", "One two three four")) == 1 and ("heading", "Red Shoe") in got
    assert [r.text for r in snippets.hero(snippets.blocks(rows), ["site"]).collect()] == []  # two words, but eight characters


def test_positioning_orders_by_kind(spark):
    schema = "site string, ord long, page_type string, kind string, level int, pos int, kind_rank int, text string"
    said = spark.createDataFrame([("s", 1, "homepage", "heading", 1, 0, 1, "A hero of a heading"), ("s", 1, "homepage", "paragraph", None, 0, 2, "The home says this"), ("s", 2, "about", "paragraph", None, 0, 2, "About us it says that"), ("s", 2, "about", "paragraph", None, 1, 2, "THE HOME says this")], schema)
    own = spark.createDataFrame([("s", "We say of ourselves"), ("t", " ")], "site string, text string")
    by = lambda d, first: [r["kind"] for r in snippets.positioning(said, d, ["site"], first, 9).orderBy("place").collect()]
    assert by(own, ["about", "declared", "homepage", "hero"]) == ["about", "about", "declared", "hero"]
    assert by(own, ["hero", "declared", "homepage", "about"]) == ["hero", "declared", "homepage", "about"]
    assert by(own.withColumn("text", F.concat("text", F.lit("..."))), ["hero", "declared", "homepage", "about"])[-1] == "declared"


def node(**fields):
    t = fields["type"]
    return ([t] if isinstance(t, str) else [x for x in t if isinstance(x, str)], json.dumps({"@type": t} | {k: v for k, v in fields.items() if k != "type"}))


def test_owner_of_a_site(spark):
    data = [
        ("a", 1, 0, *node(type="Plumber", name="first by name")), ("a", 2, 0, *node(type="WebPage", name="x")), ("a", 3, 1, *node(type=["Thing", "store"], name=" Own  name ", legalName=7, alternateName=["A", 3, "B "], numberOfEmployees={"value": 12}, knowsAbout=["no"], additionalType="https://schema.org/AutoRepair", foundingDate="since 1987-01")),
        ("a", 4, 0, *node(type="Organization", name="later")), ("b", 1, 0, *node(type="RoofingContractor", numberOfEmployees="about  9", alternateName=" C ")), ("b", 2, 0, *node(type="breadcrumbList", itemListElement=[{"name": " Home "}, {"item": {"name": "Tools"}}, 3, {"item": "x"}])), ("c", 1, 0, *node(type="Person", name="p")), ("d", 1, 0, ["Dentist"], "{broken"),
    ]
    got = {r.site: r for r in structured.organizations(spark.createDataFrame(data, "site string, ord long, pos int, types array<string>, node string"), ["site"]).collect()}
    assert (got["a"].name, got["a"].legal, got["a"].alternates, got["a"].industry, got["a"].founded, got["a"].staff) == ("Own name", "7", ["A", "B"], "Auto Repair", 1987, "12")
    assert (got["b"].name, got["b"].industry, got["b"].staff, got["b"].alternates, got["b"].trail) == (None, "Roofing Contractor", "about 9", ["C"], ["Home", "Tools"])
    assert got["c"].name is None and got["c"].types == [] and got["d"].name is None and len(got) == 4


def test_common_category_recurs_or_is_alone(spark):
    rows = [("a", 1, "Pest  control"), ("a", 2, "pest control"), ("a", 3, "Roofs"), ("b", 1, "Only"), ("c", 1, "x"), ("c", 2, "y"), ("d", 1, "Services"), ("d", 2, None)]
    got = {r.site: r.category for r in entities.common_category(spark.createDataFrame(rows, "site string, place long, category string"), ["site"], ["services"]).collect()}
    assert got == {"a": "Pest control", "b": "Only"}


def test_dictionaries_in_one_pass(spark):
    lists = matcher.Phrases({"d": {"x": ["ab", "b c", ""], "y": ["CD"]}, "e": {"z": ["abc", "ab"]}})
    df = spark.createDataFrame([("xAB cd",), ("abc",), ("",), (None,), ("b\nc",)], "t string")
    got = [(r.h, r.d, r.e) for r in df.select(lists.hits(df.t).alias("h"), lists.labels(lists.hits(df.t), "d").alias("d"), lists.labels(lists.hits(df.t), "e").alias("e")).collect()]
    assert got == [([0, 1, 3, 5], ["x", "y"], ["z"]), ([0, 4, 5], ["x"], ["z"]), ([], [], []), ([], [], []), ([], [], [])]
    links = spark.createDataFrame([("Meet our TEAM!", "https://a.com/p/1"), (None, "https://a.com/About_us/?team"), ("teammates", "https://a.com/"), ("our", "https://a.com/team-x"), ("contact", "/us")], "text string, url string")
    types = {"about": ["about", "our team"], "team": ["team"], "contact": ["contact us", "contact"]}
    assert [r[0] for r in links.select(discover.page_types(links.text, links.url, types)).collect()] == [["about", "team"], ["about"], [], ["team"], ["contact"]]
    assert matcher.Phrases({"d": {"x": []}}).patterns() == []
