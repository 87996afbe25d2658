"""Findings F10, F11 and F12 of the third round: pages that can't say what is asked for aren't read as trees, and a text is cleaned once."""

import random

from test_pages_at_scale import MARKUP

from pagequarry.operators import dom, parsed, snippets
from pagequarry.plans import sites

PHRASES = ["dba", "d/b/a", "doing business as", "a café"]
BITS = [
    "d", "ba", "b", "a ", "d/", "dba", "DOING ", "doing", " business", "\xa0", "&nbsp;", " as ", "<b>", "</b>", "<p>", "</p>", "<br>", "<br/>", "&#100;", "&sol;", "caf&eacute;", "café", "<script>x</script>", "<script>a<b</script>", "<style>s</style>", "<noscript>", "</noscript>", "<svg>", "</svg>", "<SVG>", "</Svg>",
    "<!-- c -->", "<!-- > -->", "<a title='>'>", '<a title="dba">', "</a>", "<div>", "</div>", "<template>", "</template>", "\n", "x",
]
PLAIN = "<html><head><title>Firm</title><script>{}</script></head><body><main><h1>t</h1><p>Plain words with nothing to say about anything at all.</p></main></body></html>"


def test_no_page_that_has_a_phrase_is_left_out():
    said, r, had = parsed.Said(PHRASES), random.Random(5), 0
    pages = [*MARKUP, *("".join(r.choice(BITS) for _ in range(r.randint(2, 12))) for _ in range(20000))]
    pages += [f"<main><p>{h}</p></main>" for h in pages]
    for html in pages:
        root = dom.parse(html)
        texts = [t.lower() for t in (root.text(), *(row[1] for row in parsed.RELATIONS["main"].of_tree(root)))]
        if any(p in t for p in PHRASES for t in texts):
            had += 1
            assert said.may_be_in(html), html
    assert had > 300


def test_pages_without_a_phrase_are_skimmed():
    said = parsed.Said(PHRASES)
    assert not said.may_be_in(PLAIN) and said.may_be_in(PLAIN.replace("nothing", "d/<b>b/a</b>"))
    assert not said.may_be_in("<p>do<script></script>x</p>".replace("do", "no")) and said.may_be_in("<p>do<script></script>ing business as</p>")


def test_rows_of_pages_that_may_say_it_are_whole(spark):
    df = spark.createDataFrame([(1, PLAIN), (2, PLAIN.replace("Plain", "Peak, d/b/a Crew,"))], "ord int, html string")
    whole = parsed.parse(df, ["title", "main"])
    some = parsed.parse(df, ["title", "main"], saying={"main": PHRASES})
    key = lambda rows: sorted(map(str, rows))
    assert key(some.collect()) == key(whole.filter("relation <> 'main' OR ord = 2").collect())


def test_scripts_frames_and_links_are_skimmed():
    page = PLAIN.replace("<h1>", '<iframe src="x">y</iframe><link rel="icon" href="z"><h1>')
    assert [n.tag for n in parsed.tree_of(page, ["reference"]).tree[1:]] == ["script", "iframe", "link"]


def test_sites_that_say_nothing_of_a_role_stay(spark):
    got = {r.site for r in sites.site_roles(spark, "/root/testdata/sf0.001").collect()}
    assert got == {r.site for r in sites.site_pages(spark, "/root/testdata/sf0.001").select("site").distinct().collect()}


def test_a_text_is_cleaned_once(spark):
    df = spark.createDataFrame([(1, "homepage", 1, PLAIN)], "site int, page_type string, ord int, html string")
    rows = snippets.blocks(parsed.parse(df, ["heading", "main"]))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert [r.text for r in rows.filter("kind = 'paragraph'").collect()] == ["Plain words with nothing to say about anything at all."]
    assert plan.count("regexp_replace") < 20
