"""Findings of the fourth round."""

from pagequarry.operators import dom, parsed


def asked(html):
    return [r[:2] for r in dom.questions.of_tree(dom.parse(html))]


def test_f4_accordions_give_questions(spark):
    page = (
        '<div class="Accordion-list"><div class="accordion-item"><button class="accordion-question">How do I pay?</button><div class="answer-body">By card or cash.</div></div>'
        '<div class="accordion-item"><h5>Which sizes exist</h5><p>Small and large.</p></div><div class="accordion-item"><h5>Our story so far</h5><p>Long ago.</p></div></div>'
        '<section class="faqs"><h2>Do you ship?</h2><span class="faq-answer">Yes, everywhere.</span></section>'
        '<div itemscope itemtype="https://schema.org/Question"><b itemprop="name">Is it safe?</b><i itemprop="text">It is.</i></div>'
    )
    want = [("How do I pay?", "By card or cash."), ("Which sizes exist", "Small and large."), ("Do you ship?", "Yes, everywhere."), ("Is it safe?", "It is.")]
    assert asked(page) == want
    df = spark.createDataFrame([(1, page), (2, '<div class="accordion"><div itemprop="name">Will it rain today</div></div>'), (3, "<p><strong>Why is it wet?</strong><em>Because it rained.</em></p>"), (4, "<h1>What is this?</h1>")], "ord int, html string")
    got = sorted((r.ord, r.pos, r.question, r.answer) for r in parsed.of(parsed.parse(df, ["question"]), "question").collect())
    assert got == [(1, i, *x) for i, x in enumerate(want)] + [(2, 0, "Will it rain today", None), (3, 0, "Why is it wet?", "Because it rained.")]


def test_f4_each_step_in_its_order_and_each_question_once():
    page = (
        '<script type="application/ld+json">{"@type":"FAQPage","mainEntity":[{"@type":"Question","name":"Who  are you?","acceptedAnswer":{"text":"<p>A firm</p>"}},{"@type":"Question","acceptedAnswer":{"text":"Yes"}}]}</script>'
        "<h3>Who are you?</h3><p>Somebody else, it seems.</p><div class='faq'><h3>WHERE are you?</h3><p>There</p></div><details>More: <summary>Where are you?</summary>Here</details><strong>What now?</strong><p>Short</p>"
    )
    assert asked(page) == [("Who are you?", "A firm"), (None, "Yes"), ("Where are you?", "More: Here"), ("What now?", None)]


def test_f3_pages_of_one_template_share_its_tree():
    import random

    from test_pages_at_scale import MARKUP
    from test_skimmed_pages import BITS, PAGE

    from pagequarry.operators import readability, templates

    r = random.Random(4)
    bits = [*BITS, "<main>", "</main>", "<p>a text of twenty-five letters, at least, and more. </p>", '<a href="/x">a link</a>', "<li>one</li>", "<div class='content'>", "<section>", "</section>", "<td>1, 2, 3, 4, 5, 6, 7, 8, 9, 10</td>", "<nav>", "</nav>", "<div role='main'>"]
    pages = [PAGE, *MARKUP, *("".join(r.choice(bits) for _ in range(r.randint(1, 12))) for _ in range(600))]
    texts = ["", "x", "a &amp; b", "one, two, three, four, five; six &lt;seven&gt; eight and nine", "a text that is quite long. " * 6]
    for html in pages:
        parts = dom._MARKUP.split(html)
        for _ in range(4):
            like = "".join(x if i % 2 or not x else r.choice(texts[1:]) for i, x in enumerate(parts)).replace('href="/x"', f'href="/{r.randrange(99)}"')
            assert readability.main_blocks.of_tree(parsed.tree_of(like, ["main"])) == readability.main_blocks.of_tree(dom.parse(like)), like
    assert sum(t is not None for t in templates._KEPT.values()) > 200
    one, two = (parsed.tree_of(f'<main><p>{t}</p><a href="/{t}">b</a></main>', ["main"]) for t in ("x", "y"))
    three = parsed.tree_of('<main><p>z</p><a href="/z">b</a></main>', ["main"])
    assert one is not two and two is three and three.first("p").text() == "z"


def test_f3_only_texts_with_a_signal_are_judged(spark):
    from pyspark.sql import functions as F

    from pagequarry.operators import snippets

    signals = {"a": ["save money", "cookie"], "b": ["Own ed"], "none": []}
    texts = ["We help you SAVE  money.", "save money", "save​ money now, all of you", "Accept all cookies", "cookie", "We own ed this for years", "!!!", "", "  ", "plain words of no signal", "Skip to save money", "own ed, and save money too"]
    pages = [(i, f"<main><p>{t}</p><p>{t} (2)</p><li>{t}</li></main>") for i, t in enumerate(texts)]
    rows = parsed.parse(spark.createDataFrame(pages, "ord int, html string"), ["main"]).persist()
    columns = ["ord", "kind", "kind_rank", "pos", "text", "signals"]
    want = snippets.with_signals(snippets.prose(snippets.blocks(rows)), signals).filter(F.size("signals") > 0).select(columns)
    got = snippets.passages_with_signals(rows, signals).select(columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 8
    above, _ = got._jdf.queryExecution().optimizedPlan().toString().split("EvalPython", 1)
    assert "CASE WHEN" in above  # the judgement wasn't moved below the search for phrases
