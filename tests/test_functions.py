"""Edge cases of functions and operators on small fixtures."""

import pytest
from pyspark.sql import functions as F

from pagequarry.functions import dictionaries as di
from pagequarry.functions import text as tx
from pagequarry.functions import urls
from pagequarry.operators import dom, extract, order, registry, repository, resolve
from pagequarry.sources import tables
from pagequarry.streaming import progress


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("text", "reason"),
    [(None, "empty"), ("", "empty"), ("​​", "empty"), ("———", "no-letters"), ("Cart (0)", "exact-match"), ("Cart 0", "exact-match"), ("Cart · 2", "exact-match"), ("Your cart is empty!", "banner-phrase"), ("Shop All", None), ("Notify Me!", None)],
)
def test_noise_reason(spark, text, reason):
    assert one(spark, text, lambda x: tx.noise_reason(x, di.NOISE_EXACT, di.NOISE_CONTAINS)) == reason


@pytest.mark.parametrize(
    ("text", "price"),
    [("$1500 flat", "$1500"), ("costs from $45/hour", "from $45/hour"), ("Billed per project", "per project"), ("$20 per project", "$20 per project"), ("we care", None), (None, None)],
)
def test_price(spark, text, price):
    assert one(spark, text, lambda x: tx.price_in(x, di.PRICING_MODELS)) == price


@pytest.mark.parametrize(("text", "reason"), [("", "empty"), (None, "empty"), ("a b.com", "spaces"), ("javascript:alert(1)", "host"), ("localhost", "host"), ("example.com", None), ("https://a.example.co/x?y", None), ("ftp://a.com", "scheme")])
def test_rejection(spark, text, reason):
    assert one(spark, text, urls.rejection) == reason


@pytest.mark.parametrize(("href", "want"), [("/a?b#c", "https://x.com/a?b"), ("b", "https://x.com/d/b"), ("../z", "https://x.com/z"), ("mailto:a@b.c", None), ("//y.com/q", "https://y.com/q"), ("HTTP://Y.com", "http://y.com/"), (None, None)])
def test_resolve(spark, href, want):
    df = spark.createDataFrame([(href, "https://x.com/d/e")], "h string, b string")
    assert df.select(urls.resolve(F.col("h"), F.col("b"))).first()[0] == want


@pytest.mark.parametrize(("url", "want"), [("https://a.com/x/", "https://a.com/x"), ("https://a.com/", "https://a.com/"), ("https://a.com/x/?q=1#f", "https://a.com/x?q=1"), ("https://a.com/x?", "https://a.com/x"), ("no url", "no url"), (None, None)])
def test_canonical(spark, url, want):
    assert one(spark, url, urls.canonical) == want


@pytest.mark.parametrize(("text", "yes"), [("two words", False), ("two words here", True), ("singleword_long", False), ("​tiny a", False), (None, None)])
def test_substantive(spark, text, yes):
    assert one(spark, text, tx.substantive) == yes


@pytest.mark.parametrize(("value", "placeholder", "yes"), [("", "", False), ("p", "p", False), ("", "p", True), ("[MOCK x]", "p", False), ("mine", "p", True), ("mine", "", True), (None, None, False)])
def test_reviewed(spark, value, placeholder, yes):
    df = spark.createDataFrame([(value, placeholder)], "v string, p string")
    assert df.select(registry.is_reviewed(F.col("v"), F.col("p"))).first()[0] == yes


def test_title_words(spark):
    assert one(spark, "open sans-b", tx.title_words) == "Open Sans-B"


def test_years_skip_copyright(spark):
    df = spark.createDataFrame([(1, "about", "Copyright 2019. Serving since 1941. Started small in 2003."), (1, "homepage", "founded in 1899"), (2, "about", None)], "id int, source string, text string")
    got = {r.id: (r.year, r.rejected) for r in resolve.founding_year(extract.years(df, ["id", "source"], 2026), ["id"]).collect()}
    assert got == {1: (2003, [1899, 1941])}


def test_keep_first_is_null_safe(spark):
    df = spark.createDataFrame([(None, 2, "b"), (None, 1, "a"), ("x", 3, "c")], "k string, o int, v string")
    assert sorted(r.v for r in order.keep_first(df, ["k"], ["o"]).collect()) == ["a", "c"]


def test_sale_price_and_people():
    tree = dom.parse('<div class="product-card"><h3>Cap</h3><s>$30</s> $20</div><div class="offer"><h3>Mug</h3><del>$9</del></div>')
    assert [(x[0], x[2], x[3]) for x in dom.offerings.of_tree(tree)][:2] == [("Cap", "$20", "$30"), ("Mug", "$9", None)]
    tree = dom.parse("<h3>Ann Lee</h3><p>Baker</p><h3>Our bread</h3>")
    assert dom.people.of_tree(tree) == [("Ann Lee", "Baker", None, [], 2)]


def test_broken_markup():
    assert dom.parse(None).text() == "" and dom.parse("<p><b>a<br>b<p>c</div>").text().split() == ["a", "b", "c"]
    assert dom.json_nodes(dom.parse('<script type="application/ld+json">{oops</script>')) == []


def test_industry_needs_two(spark):
    rows = [(1, 0, "Baking"), (1, 1, "service"), (1, 2, "baking "), (1, 3, "Milling"), (2, 0, "A"), (2, 1, "B"), (3, 0, "Solo")]
    got = {r.k: r.industry for r in resolve.industry(spark.createDataFrame(rows, "k int, ord int, category string"), ["k"], di.GENERIC_CATEGORIES).collect()}
    assert got == {1: "Baking", 3: "Solo"}


def test_hard_delete_keeps_history_unless_promoted(spark):
    kbs = spark.createDataFrame([(1, 7, 1, 1, True), (2, 7, 0, 0, False), (3, 8, 0, 0, True)], "id int, company_id int, created_at int, seq int, is_current boolean")
    companies, sections = spark.createDataFrame([(7,), (8,)], "id int"), spark.createDataFrame([(1, "a")], "kb_id int, section string")
    ids = spark.createDataFrame([(1,), (3,)], "id int")
    c, k, s = repository.hard_delete(companies, kbs, sections, ids)
    assert [r.id for r in c.collect()] == [7] and [(r.id, r.is_current) for r in k.collect()] == [(2, False)] and s.isEmpty()
    assert repository.hard_delete(companies, kbs, sections, ids, promote=True)[1].first().is_current


def test_missing_store_is_empty(spark, tmp_path):
    assert tables.store(spark, str(tmp_path / "none"), "id int").isEmpty()


def test_progress_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text('{"type":"stage","scan_id":"s","seq":1,"stage":"fetch","completed":1}\n\n{bad\n{"type":"page-failed","scan_id":"s","seq":2,"url":"u"}\n{"type":"done","scan_id":"s","seq":3,"stage":"save"}\n')
    q = progress.fold(progress.events(spark, str(src))).writeStream.outputMode("complete").format("memory").queryName("folded").start()
    try:
        q.processAllAvailable()
        r = spark.sql("SELECT * FROM folded").first()
        assert (r.scan_id, r.stage, r.completed, r.failures, r.done) == ("s", "save", 1, 1, True)
    finally:
        q.stop()
