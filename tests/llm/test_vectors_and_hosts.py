"""Hard negatives, whitening and the graph of hosts against brute force, with nulls, ties, repeats and clashing columns."""

import math
import random

import numpy as np
import pytest

from pagequarry.llm import negatives, queries, urlgraph, vectors, whitening

ROWS = "vec_id long, embedding array<float>, label int, rid long, id long, nil int, score long, x string, g int, rank int, component int, host string"


def clash(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4, "x", 5, 6, 7, "h") for r in rows], ROWS).repartition(3)


def scaled(v):
    return [math.floor(256 * c) for c in np.array(v, dtype=np.float32).astype(float)]


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    out = [(i, [r.gauss(0, 0.3) for _ in range(70)], r.randrange(4)) for i in range(330)]
    out += [(400 + i, out[100][1], 1) for i in range(40)]  # a common vector, so that scores tie
    out += [(500, None, 1), (501, [None] * 70, 1), (502, [float("nan")] * 70, 2), (503, [float("inf")] * 70, 2), (600, out[5][1], None), (None, out[100][1], 2), (None, out[7][1], 1)]
    return out + [out[7], out[7]]


def mined(rows):
    live = [(i, scaled(v), lab) for i, v, lab in rows if lab is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    order = lambda s: (-s[0], s[1] is None, s[1] or 0)
    for k, (i, x, lab) in enumerate(live):
        if i is None or i % 100:
            continue
        others = sorted(((sum(a * b for a, b in zip(x, y)), j, m == lab) for n, (j, y, m) in enumerate(live) if n != k), key=order)
        for ps, p, _ in [o for o in others if o[2]][:5]:
            window = [o for o in others if not o[2] and 30 * ps <= 100 * o[0] <= 90 * ps][:10]
            yield from ((i, p, n, o[1], ps, o[0]) for n, o in enumerate(window, 1))


def test_negatives_match_brute_force(spark, rows, monkeypatch):
    monkeypatch.setattr(negatives, "LEFT", 2)  # several blocks on either side
    monkeypatch.setattr(negatives, "RIGHT", 50)
    monkeypatch.setattr(negatives, "CHUNKS", 3)
    got = negatives.mine(negatives.prepared(clash(spark, rows))).collect()
    assert got and sorted(map(str, map(tuple, got))) == sorted(map(str, mined(rows)))


def test_negatives_of_odd_tables(spark):
    assert negatives.mine(negatives.prepared(clash(spark, []))).collect() == []
    one = [(0, [1.0, 2.0], 1), (1, [3.0], 1), (2, [0.5], 2), (3, [], 2)]  # shorter vectors count as if filled up with 0
    assert [tuple(r) for r in negatives.mine(negatives.prepared(clash(spark, one))).collect()] == list(mined([(0, [1.0, 2.0], 1), (1, [3.0, 0.0], 1), (2, [0.5, 0.0], 2), (3, [0.0, 0.0], 2)]))
    far = [(0, [1e30, 1.0], 1), (1, [1e30, 2.0], 1), (2, [5e29, 1.0], 2)]  # bounded, not wrapped
    assert all(r.positive_score > 0 for r in negatives.mine(negatives.prepared(clash(spark, far))).collect())


def test_wide_products_are_exact():
    assert negatives.chunks(64) == [(0, 32), (32, 64)] and len(negatives.chunks(4096)) == negatives.CHUNKS and negatives.chunks(1) == [(0, 1)]
    about = np.array([[0, 1, 2, 3], [9, 8, 7, 6], [0, 0, 0, 1], [0, 0, 0, 0]])
    assert list(negatives._first(2, np.array([True] * 4), np.array([5, 7, 7, 7]), about)) == [2, 1]


def whitened(rows):
    live = [(i, scaled(v)) for i, v, _ in rows if v is not None and len(v) == 70 and all(c is not None and math.isfinite(c) for c in v)]
    points = np.array(sorted({tuple(x) for _, x in live}), dtype=float)
    n, sums = len(points), [int(s) for s in points.sum(axis=0)]
    values, axes = np.linalg.eigh(np.cov(points.T, bias=True))
    return live, n, sums, values[::-1], axes[:, ::-1].T, points.mean(axis=0)


def test_whitening_matches_brute_force(spark, rows):
    table = clash(spark, [*rows, (700, [1.0] * 3, 0), (701, [], 0)])
    got = whitening.whiten(table, whitening.fit(table)).collect()
    live, n, sums, values, axes, mean = whitened(rows)
    assert len(got) == 4 * len(live) and {r.n for r in got} == {n}
    by = {(i, k): (sum((n * c - s) ** 2 for c, s in zip(x, sums)), float((np.array(x) - mean) @ axes[k - 1]) / math.sqrt(values[k - 1])) for i, x in live if i is not None for k in range(1, 5)}
    sign = {}
    for r in (r for r in got if r.vec_id is not None):
        deviation, value = by[r.vec_id, r.component]
        if abs(value) > 0.1:
            sign.setdefault(r.component, 1 if r.whitened * value > 0 else -1)
    for r in (r for r in got if r.vec_id is not None):
        deviation, value = by[r.vec_id, r.component]
        assert r.deviation == deviation and abs(r.whitened - sign[r.component] * value) < 1e-8
        assert abs(r.explained - values[r.component - 1] / values.sum()) < 1e-9 and r.identity_error < 1e-9


def test_whitening_of_odd_tables(spark):
    for table in ([], [(1, None, 1)], [(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1)]):
        df = clash(spark, table)
        assert whitening.whiten(df, whitening.fit(df)).collect() == []
    line = clash(spark, [(i, [float(i), 2.0 * i], 1) for i in range(5)])  # one direction only
    assert {r.component for r in whitening.whiten(line, whitening.fit(line)).collect()} == {1}
    far = [(1, [3e16, 0.0], 1), (2, [-3e16, 1.0], 1), (3, [0.0, 2.0], 1)]
    got = whitening.whiten(clash(spark, far), whitening.fit(clash(spark, far))).collect()
    assert {r.vec_id: r.deviation for r in got} == {1: None, 2: None, 3: 589824}
    near = [(i, [3e5 * i, 1.0], 1) for i in range(40)]  # over the quick bound, but a long
    got = {r.vec_id: r.deviation for r in whitening.whiten(clash(spark, near), whitening.fit(clash(spark, near))).collect()}
    xs = [scaled(v) for _, v, _ in near]
    sums = [sum(x[d] for x in xs) for d in range(2)]
    assert all(got[i] == (t if (t := sum((40 * x[d] - sums[d]) ** 2 for d in range(2))) < 2**63 else None) for i, x in enumerate(xs))


def test_scaled_takes_floors(spark):
    df = spark.createDataFrame([([-0.001, -0.0, 0.999],)], "v array<float>")
    assert df.select(vectors.scaled("v")).first()[0] == [-1, 0, 255]


def propagated(edges, seeds, rounds):
    """edges {(src, dst): n}, seeds {(host, kind): seed}."""
    steps = [((s, "t"), d, urlgraph.DAMPING * n / sum(m for (a, _), m in edges.items() if a == s)) for (s, d), n in edges.items()]
    steps += [((d, "d"), s, urlgraph.DAMPING * n / sum(m for (_, b), m in edges.items() if b == d)) for (s, d), n in edges.items()]
    ranks = dict(seeds)
    for _ in range(rounds):
        new = dict(seeds)
        for (host, kind), to, share in steps:
            new[to, kind] = new.get((to, kind), 0) + math.floor(ranks.get((host, kind), 0) * share)
        ranks = {k: v for k, v in new.items() if v > 0}
    return ranks


def link(*hosts):
    return "".join(f"<p><a class=b href='{h}'>x</a>" for h in hosts)


def test_trust_and_distrust_follow_links(spark):
    r = random.Random(8)
    hosts = [f"h{i}.example.{t}" for i in range(25) for t in ("net", "org")] + ["spam.com", "fair.com"]
    pages = [(i, f"HTTPS://{h.upper()}/{r.choice(['', 'fr/a', 'de/b', 'en/1'])}?q#f", link(*[f"{r.choice(['http:', 'HTTPS:', ''])}//{r.choice(hosts)}/z" for _ in range(r.randrange(4))], "/own", "mailto:a@b")) for i, h in enumerate(hosts * 4)]
    df = spark.createDataFrame([(*p, "c", 1, "k") for p in pages], "page_id long, url string, html string, host string, n int, kind string").repartition(3)
    rows = urlgraph.ruled(df, queries.URL_RULES)
    edges, seeds = {}, {}
    for row in rows.collect():
        if row.action:
            key = (row.host, "t" if row.action == "allow" else "d")
            seeds[key] = seeds.get(key, 0) + urlgraph.UNIT
    for i, _, html in pages:
        src = hosts[i % len(hosts)]
        for dst in {x.split("'")[0].split("//")[1].split("/")[0] for x in html.split("href='")[1:] if "//" in x.split("'")[0]} - {src}:
            edges[src, dst] = edges.get((src, dst), 0) + 1
    assert {(x.src, x.dst): x.n for x in urlgraph.host_edges(df).collect()} == edges
    given = spark.createDataFrame([(h, k, v) for (h, k), v in seeds.items()], "host string, kind string, seed long")
    got = urlgraph.spread(spark.createDataFrame([(*k, n) for k, n in edges.items()], "src string, dst string, n long"), given)
    want = propagated(edges, seeds, urlgraph.ROUNDS)
    assert {(x.host, x["kind"]): x["rank"] for x in got.collect()} == want
    bad = {h for h in hosts if (d := want.get((h, "d"), 0)) and d >= urlgraph.BLOCK_AT * (want.get((h, "t"), 0) + d)}
    verdicts = {x.page_id: (x.rule, x.verdict) for x in urlgraph.judge(df, queries.URL_RULES).collect()}
    assert bad and any(v == (None, "block") for v in verdicts.values()) and any(v == (None, "allow") for v in verdicts.values())
    assert all(v == ("block" if hosts[i % len(hosts)] in bad else "allow") for i, (rule, v) in verdicts.items() if rule is None)


def test_rules_and_odd_urls(spark):
    urls = ["http://a.example.org/es/1", "http://example.org/es", "http://badexample.org/es/x", "http://example.org/en/12", "http://x.com/fr/1", "http://x.com", "http://org/x", "example.org/es/", None, "", "x://", "http://M.COM/de/?/fr/", "a://b.com#/fr/", "http://b.com?x=//c.org/es/", "http://x.org:80/a"]
    df = spark.createDataFrame([(i, u, None if i % 2 else "") for i, u in enumerate(urls)] + [(None, urls[0], "<a href=//far.net"), (0, urls[0], "")], "page_id long, url string, html string")
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in urlgraph.judge(df, queries.URL_RULES).collect()]
    by = {g[0]: g[1:] for g in got}
    assert len(got) == len(urls) + 2 and sum(g[0] == 0 for g in got) == 2 and by[None] == by[0]
    assert by[0] == ("a.example.org", "/es/1", "example.org/es/", "block") and by[1][2:] == ("org/", "allow") and by[2][2:] == ("org/", "allow") and by[3][2:] == ("example.org/en/1", "block")
    assert by[4][2:] == ("com/fr/", "allow") and by[5] == ("x.com", "", None, "allow") and by[6][2:] == ("org/", "allow")
    assert by[7] == by[8] == by[9] == by[10] == ("", "", None, "allow")
    assert by[11] == ("m.com", "/de/", "com/de/", "block") and by[12] == ("b.com", "", None, "allow") and by[13][:2] == ("b.com", "") and by[14] == ("x.org:80", "/a", None, "allow")
    assert urlgraph.judge(df.limit(0), queries.URL_RULES).collect() == []
