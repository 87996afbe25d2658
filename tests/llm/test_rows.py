"""Rows without a doc_id, with the same one, and equal rows: decisions fall on single rows."""

import random

import pytest

from pagequarry.llm import decontaminate, jaccard, licenses, stages, substrings

R = random.Random(4)


def words(n):
    return " ".join(f"v{R.randrange(10**6)}" for _ in range(n))


ONE, PASSAGE, LEAK = words(60), words(30), words(12)
CLEAN = [words(50), words(45), "plain text"]
TEXTS = [ONE, ONE + " more", f"{words(40)} {PASSAGE}", f"{PASSAGE} {words(20)}", f"{words(30)} {LEAK}", licenses.NOTICES["MIT"][0], *CLEAN, "", None]


@pytest.fixture(scope="module", params=[None, 7])
def rows(request, spark):
    """Documents of one doc_id or of none, with columns whose names the operators use themselves, and one row twice."""
    data = [(request.param, t, "en", "s", 0, "clash") for t in [*TEXTS, CLEAN[0]]]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, key string").withColumnRenamed("lang", "spans").repartition(4)


def test_operators(spark, rows):
    n = len(TEXTS) + 1
    hit = decontaminate.judge(rows, spark.createDataFrame([(1, LEAK)], "item_id long, text string")).collect()
    assert len(hit) == n and [x.n_words for x in hit if x.contaminated] == [42]
    found = licenses.judge(rows, licenses.templates(spark)).collect()
    assert len(found) == n and [(x.licenses, x.n_matches) for x in found if x.n_matches] == [("MIT", 1)]
    kept = substrings.remove_repeats(rows, texts=True).collect()
    assert len(kept) == n and sorted(x.n_removed for x in kept if x.n_removed) in ([30, 60], [30, 60, 60]) and all(x.n_removed == 0 for x in kept if x.kept in CLEAN)
    near = jaccard.near_duplicates(rows).collect()
    assert len(near) == n and {x.component_id for x in near} == {near[0].doc_id}


def test_stages(spark, rows, tmp_path):
    spark.createDataFrame([(1, LEAK)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    clean = stages.decontaminate(spark, rows, str(tmp_path))
    assert clean.dtypes == rows.dtypes and sorted(str(x.text) for x in clean.collect()) == sorted(str(t) for t in [*TEXTS, CLEAN[0]] if not t or LEAK not in t)
    one = [x.text for x in stages.one_of_each_group(spark, rows, str(tmp_path)).collect()]
    assert sorted(str(t) for t in one if t not in (ONE, ONE + " more")) == sorted(str(t) for t in TEXTS[2:]) and sum(t in (ONE, ONE + " more") for t in one) == 1
    cut = stages.remove_repeats(spark, rows, str(tmp_path))
    left = [x.text for x in cut.collect()]
    assert cut.dtypes == rows.dtypes and all(t in left for t in CLEAN) and "" in left and None in left and sum(PASSAGE in (t or "") for t in left) == 1
    mixed = stages.mix_sources(spark, rows, str(tmp_path)).collect()
    assert {x.text for x in mixed} == set(TEXTS) and mixed[0].key == "clash"


def test_long_runs_of_one_word(spark):
    """A path longer than what a row can hold is split; every window but the first repeats it."""
    most = substrings.MOST
    got = substrings.remove_repeats(spark.createDataFrame([(1, "x " * (most + 500)), (2, "x " * 30)], "doc_id long, text string")).collect()
    assert sorted((x.doc_id, x.n_words, x.n_removed) for x in got) == [(1, most + 500, most + 499), (2, 30, 30)]


@pytest.mark.parametrize("links", [7, 500_000])  # several tasks and star rounds; one task
def test_components_against_union_find(spark, monkeypatch, links):
    import random

    from pagequarry.llm import components

    monkeypatch.setattr(components, "TASK_LINKS", links)
    r = random.Random(2)
    pairs = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(5, 5), (-3, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {x.id: x.component for x in components.components(spark.createDataFrame(pairs, "x long, y long")).collect()}
    assert got == {x: find(x) for x in parent if any(x in p for p in pairs if p[0] != p[1])}
    assert components.components(spark.createDataFrame([], "x long, y long")).isEmpty()
