"""Findings of the third round: one parse for plain markup and for the parser's, and pages dealt to tasks."""

import os

import pytest

from pagequarry.operators import dom, parsed, snippets
from pagequarry.plans import sites
from pagequarry.sources import tables

SF = "/root/testdata/sf0.001"
MARKUP = [
    "<p>a &amp b &lt;c&gt; &copy d &#39;e&#39 &nbsp;</p>", '<div class="a"id=b>x<p>y<p>z</div><br/><img src=x>t', "<script>if (a < b && c &amp; d) {'</p>'}</script><p>q</p>", "<style>a{}</style >x", "a < b <3 <p>c", "<SCRIPT>never closed", "<!-- x --><!DOCTYPE html><P CLASS='A&amp;B' hidden>t</P>",
    "<ul><li>a<li>b<ul><li>c</ul></ul><table><tr><td>1<td>2<tr><td>3</table>", "</p></div>text<h1>a<b>b</b></h1 ><h2/>", "<details><summary>Is it?</summary>Yes</details>", "", "plain", "<p", "<p a='1", "<svg><p>no</p></svg><p>yes</p>",
]


def shape(node):
    return (node.tag, node.attrs, "".join("" if not isinstance(c, str) else c for c in node.children), [shape(c) for c in node.children if not isinstance(c, str)])


@pytest.mark.parametrize("html", MARKUP)
def test_plain_markup_gives_the_parsers_tree(html):
    plain = dom._plain(html)
    assert plain is None or shape(plain) == shape(dom._by_parser(html))
    tree = dom.parse(html)
    below = lambda n: [n, *[x for c in n.children if not isinstance(c, str) for x in below(c)]]
    assert all(list(n.walk()) == below(n) for n in tree.tree)


def test_marks_leave_no_rows_out(spark):
    pages = [*MARKUP, "<q class='testi&#109;onial'>a quote that is long enough to be one</q>", "<script type='application/ld+json'>{\"@type\":\"\\u0052eview\",\"reviewBody\":\"a quote that is long enough to be one\"}</script>", "<BLOCKQUOTE>a quote that is long enough to be one</BLOCKQUOTE>"]
    for name, marks in parsed.MARKS.items():
        gives = [h for h in pages if list(parsed._facts(dom.parse(h), [name]))]
        assert gives and all(parsed.may_have(h, frozenset(marks)) for h in gives) or name in ("meta", "title", "offer", "person")
    df = spark.createDataFrame(list(enumerate(pages)), "ord int, html string")
    assert sorted(r.ord for r in parsed.parse(df, ["testimonial"]).collect()) == [len(MARKUP), len(MARKUP) + 1, len(MARKUP) + 2]


def test_rows_are_handed_on_by_chunks(spark, monkeypatch):
    monkeypatch.setattr(parsed, "CHUNK", 100)
    df = spark.createDataFrame([(i, f"<h1>t{i}</h1>" + "x" * (i % 90)) for i in range(300)], "ord int, html string").repartition(2)
    assert sorted((r.ord, r.heading.text) for r in parsed.parse(df, ["heading"]).collect()) == [(i, f"t{i}") for i in range(300)]


def test_paragraphs_alone_need_no_windows(spark):
    df = spark.createDataFrame([(1, "homepage", 1, "<main>" + "<p>one two three four</p>" * 3 + "</main>")], "site int, page_type string, ord int, html string")
    rows = snippets.blocks(parsed.parse(df, ["main"]))
    assert rows.count() == 3 and "Window" not in rows._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pages_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(tables, "PAGES_A_TASK", 100)
    assert sites.site_pages(spark, SF).rdd.getNumPartitions() == 15


@pytest.mark.parametrize("html", [*MARKUP, "<div>a<noscript><p>b</p></noscript><br>c<svg>d</svg></div><p>e", "<div x=\"a>b\">t</div>", "<script>'</script >'</script><p>x</p>"])
def test_listed_pieces_give_the_same_text(html):
    listed, walked = dom.parse(html), dom._by_parser(html)
    assert [(n.tag, n.end, n.text()) for n in listed.tree] == [(n.tag, n.end, n.text()) for n in walked.tree]


def test_pages_without_rows_stay_out_of_python(spark):
    df = spark.createDataFrame([(1, "<p>x</p>"), (2, "<BLOCKQUOTE>a quote that is long enough to be one</BLOCKQUOTE>"), (3, None)], "ord int, html string")
    rows = parsed.parse(df, ["testimonial"])
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Contains" in plan or "contains(" in plan.lower()
    assert [r.ord for r in rows.collect()] == [2]


def test_a_read_tree_is_taken_apart():
    tree = dom.parse("<div><p>a</p></div>").tree
    nodes = list(tree)
    tree.part()
    assert not tree and all(n.parent is None and n.children is None for n in nodes)
