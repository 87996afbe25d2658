"""Findings F8, F9 and F13 of the third round: relations that need some elements alone don't read a page as a tree."""

import random

import pytest
from test_pages_at_scale import MARKUP

from pagequarry.operators import dom, parsed

PAGE = '<html><head><title>A &amp; B</title><meta name="k" content="v"><script type="application/ld+json">{"@type":"Service","name":"x"}</script></head><body><main><h1>t</h1><p>a <b>b</b></p></main><footer>certified by <!-- c -->nobody</footer></body></html>'
BITS = [
    "<script>x</script>", '<SCRIPT type="application/LD+json">[{"@type":"Service","name":"y"}]</SCRIPT >', '<script type="application/ld+json">{"@type":"Organization"}</script>', "<script>a<b</script>", '<script src="x"/>', "<script>", "<footer>a &amp; b</footer>", "<footer>", "</footer>", "<noscript>", "</noscript>",
    "<title>t</title>", "<title> </title>", "<TITLE>q", '<meta property="og:x" content="y">', "<meta name=k content=v>", '<meta name="k" content="a&lt;b"/>', "</meta>", "<!-- c -->", "<!-- <script>x</script> -->", '<a title="<script>">', "<style>a<b</style>", "<style>s</style>", "<p", "<p>", "<div class='badge'>", "</div>", "<h3>h</h3>", "<h4>h</h4>", '<div class="product">', "text & more", "<br/>",
]
SETS = [[n] for n in parsed.SKIMMED] + [["json_ld", "meta", "title", "offer"], ["json_ld", "meta", "title"]]


@pytest.mark.parametrize("wanted", SETS, ids="-".join)
def test_skimmed_rows_are_the_trees_rows(wanted):
    r = random.Random(7)
    pages = [PAGE, *MARKUP, *("".join(r.choice(BITS) for _ in range(r.randint(1, 10))) for _ in range(2000))]
    for html in pages:
        assert list(parsed._read(parsed.tree_of(html, wanted), wanted)) == list(parsed._read(dom.parse(html), wanted)), html
    tags = frozenset().union(*(parsed.SKIMMED[n][0] for n in wanted))
    assert sum(dom.skim(html, tags) is not None for html in pages) > 400


def test_skimmed_pages_have_no_other_nodes():
    page = PAGE.replace("<!-- c -->", "")
    assert [[n.tag for n in parsed.tree_of(page, w).tree[1:]] for w in (["json_ld"], ["title", "meta"], ["credential"])] == [["script"], ["title", "meta"], ["footer"]]
    assert dom.skim(PAGE, frozenset({"footer"})) is None and len(parsed.tree_of(PAGE, ["credential"]).tree) > 8  # a footer of several parts is read as a tree
    assert len(parsed.tree_of(page.replace("<footer>", "<footer class='award'>"), ["credential"]).tree) > 8
