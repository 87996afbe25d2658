"""Operators over documents against plain brute force, and on edge cases."""

import collections
import hashlib
import math
import os
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagequarry.llm import contextmix, decontaminate, jaccard, licenses, mixing, substrings, textkernel, toxicity
from pagequarry.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_kernel_words_and_hashes():
    import pyarrow as pa

    col = pa.array(["a bb  ccc", None, "", "é ü\n", "a bb"])
    (i, j, buf, off), = textkernel.chunks(col)
    s, e, woff = textkernel.word_spans(buf, off)
    h = textkernel.word_hashes(buf, s, e)
    assert (i, j, woff.tolist()) == (0, 5, [0, 3, 3, 3, 5, 7]) and h[0] == h[5] and h[1] == h[6] and len(set(h.tolist())) == 5
    w, fits = textkernel.windows(h, woff, 2)
    assert fits.tolist() == [True, True, False, True, False, True, False] and w[0] == w[5] != w[1]


def test_substrings(docs):
    got = {r.doc_id: r for r in substrings.remove_repeats(docs, texts=True).collect()}
    seen = set()
    for d, t in sorted(texts(docs).items()):
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for i in range(len(w) - 19):
            k = tuple(w[i : i + 20])
            if k in seen:
                gone[i : i + 20] = [True] * 20
            seen.add(k)
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        assert (got[d].n_words, got[d].n_removed, got[d].kept_sha256) == (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
        assert got[d].kept == (kept if any(gone) else t)


def test_substrings_edges(empty, odd):
    assert substrings.remove_repeats(empty).isEmpty()
    got = sorted((r.doc_id or 9, r.n_words, r.n_removed) for r in substrings.remove_repeats(odd).collect())
    # the text repeats itself, and the null identifier comes last
    assert got == [(1, 30, 30), (1, 30, 30), (2, 0, 0), (9, 30, 30)] or got == [(1, 30, 29), (1, 30, 29), (2, 0, 0), (9, 30, 30)]


def brute_components(df):
    sets, parent = {}, {}
    for d, t in texts(df).items():
        w = WORD.findall((t or "").translate(LOWER))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        parent[d] = d

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def test_jaccard(docs):
    trace = []
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs, trace).collect()}
    assert got == brute_components(docs)
    assert trace and trace[0][1] > 60  # the large group went to pivots


def test_jaccard_recursion(spark):
    """Groups of near and less near copies, with limits at which regions are divided again and again by new pivots."""
    import random

    r, rows = random.Random(8), []
    for _ in range(2):
        base = [r.choice("abcdefghijklmnopqrstuvwxyz") + str(r.randrange(90)) for _ in range(60)]
        for _ in range(45):
            w = list(base)
            for _ in range(r.randint(0, 5)):
                w[r.randrange(len(w))] = f"x{r.randrange(12)}"
            rows.append((len(rows), " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    trace = []
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.near_duplicates(df, trace, room=0, block=20).collect()}
    assert got == brute_components(df)
    assert len(trace) > 1 and trace[0][3] > 0 and trace[1][1] > 0, trace


def test_jaccard_parts(spark):
    """Near copies of one text that don't link, though all are about as far from any pivot: counts by parts tell them apart at the first level."""
    import random

    r, rows = random.Random(3), []
    base = [f"w{r.randrange(10**6)}" for _ in range(300)]
    for _ in range(160):
        w = list(base)
        for k in r.sample(range(5, 295, 5), r.choice([6, 9, 9, 9])):
            w[k] = f"x{r.randrange(10**6)}"
        rows.append((len(rows), " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    trace = []
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.near_duplicates(df, trace).collect()}
    assert got == brute_components(df)
    assert all(level[3] == 0 for level in trace), trace
    sets = [np.array(sorted(r.sample(range(2000), r.randrange(1, 900))), np.uint64) for _ in range(20)]
    for p in sets[:3]:
        counts = np.stack([np.frombuffer(jaccard.parts_of(x, p), np.uint8).astype(int) for x in sets])
        for i, x in enumerate(sets):
            for j, y in enumerate(sets):
                assert np.abs(counts[i] - counts[j]).sum() <= len(np.setxor1d(x, y))


def test_jaccard_edges(empty, odd):
    assert jaccard.near_duplicates(empty).isEmpty()
    got = sorted((r.doc_id or 9, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(odd).collect())
    assert got == [(1, 1, 1), (1, 1, 1), (2, 0, 2), (9, 1, 1)]


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (200, 200)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "x long, y long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 90: 90, 95: 90, 100: 90}
    assert components(spark.createDataFrame([], "x long, y long")).isEmpty()


def test_contextmix(docs):
    from pagequarry.llm.common import fold

    got = {r.doc_id: r for r in contextmix.score(docs, contextmix.learn(docs.filter(fold(folds=10) != 0))).collect()}
    tokens = {d: [*WORD.findall((t or "").translate(LOWER)), "\n"] for d, t in texts(docs).items()}
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d in tokens}
    c = collections.Counter(w for d, ws in tokens.items() if not held[d] for w in ws)
    n, v = sum(c.values()), len(c)
    for d, ws in tokens.items():
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(ws), sum(c[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws))
        assert r.score < 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_contextmix_beats_the_base_on_held_out_texts(spark):
    """On natural texts; on the fixture's independent, equally likely words no model beats the base."""
    from pagequarry.llm.queries import op2_contextmix

    held = op2_contextmix(spark, "/root/testdata/sf0.01").filter("held_out")
    r = held.agg(F.sum("score").alias("score"), F.sum("base_score").alias("base"), F.avg((F.col("score") > F.col("base_score")).cast("int")).alias("better")).first()
    assert r.score > r.base and r.better > 0.5


def test_contextmix_probabilities_sum_to_one():
    import numpy as np

    m = contextmix.blank()
    r = np.random.default_rng(0)
    m.pairs[:] = r.integers(0, 60, m.pairs.shape) << 8 | r.integers(0, 60, m.pairs.shape)
    m.checks[:] = r.integers(0, 3, m.checks.shape)
    g = np.uint64(0x6162636400) + np.arange(256, dtype=np.uint64)
    assert (10 ** m.log10(g, np.uint64(0x123456789ABCDE00) + np.arange(256, dtype=np.uint64))).sum() == pytest.approx(1)


def test_contextmix_against_brute_force(spark, monkeypatch):
    """Scores of a small model from dictionaries of whole contexts, bit by bit, without hashes, slots or distinct values."""
    monkeypatch.setattr(contextmix, "LEAST_BITS", 23)  # so that no two contexts meet in a slot
    import random

    import numpy as np

    r = random.Random(6)
    vocabulary = ["the", "there", "then", "cat", "cattle", "sat", "on", "mat", "é", "zzz"]
    train = [" ".join(r.choices(vocabulary, range(10, 0, -1), k=r.randint(1, 40))) for _ in range(30)]
    tests = ["the cat sat on the cat sat on", "unknown Words the", "", None, "zzz " * 50]
    trained = contextmix.learn(spark.createDataFrame(list(enumerate(train)), "doc_id long, text string"))
    mixer = trained.mixer
    code = lambda t: "".join(w + " " for w in WORD.findall((t or "").translate(LOWER))).encode() + b"\n"
    counts = collections.defaultdict(lambda: [0, 0])

    def looks(s, i):
        for k in range(8):
            bit, node = s[i] >> (7 - k) & 1, (1 << k) | s[i] >> (8 - k)
            before = [(b"\n" * 4 + s)[i + 4 - o : i + 4] for o in range(1, 5)]
            yield bit, [(o, x, node) for o, x in enumerate([*before, s[:i].split(b" ")[-1]])]

    for t in train:
        for i in range(len(code(t))):
            for bit, keys in looks(code(t), i):
                for key in keys:
                    counts[key][bit] += 1

    def byte(s, i):
        total = 0.0
        for bit, keys in looks(s, i):
            n = [[float(contextmix.COUNT[contextmix.quantised(np.array([c]), np.array([c]))[0][0]]) for c in counts[k]] if k in counts else [0.0, 0.0] for k in keys]
            x = [math.log((b + contextmix.DELTA) / (a + contextmix.DELTA)) for a, b in n] + [0.3]
            known = [sum(a + b >= e - 1e-6 for e in contextmix.EDGES) for a, b in n]
            gate = known[3] * (len(contextmix.EDGES) + 1) + known[4]
            st = sum(a * float(b) for a, b in zip(x, mixer.weights[gate], strict=True))
            p = float(mixer.refined(np.array([st]), np.array([gate]))[0])
            total += math.log10(p if bit else 1 - p)
        return total

    got = {x.doc_id: x.score for x in contextmix.score(spark.createDataFrame(list(enumerate(tests)), "doc_id long, text string"), trained).collect()}
    for d, t in enumerate(tests):
        s, words = code(t), WORD.findall((t or "").translate(LOWER))
        cost, at, probabilities = [byte(s, i) for i in range(len(s))], 0, []
        for w in words:
            z = at + len(w.encode()) + 1
            probabilities.append(10 ** sum(cost[at:z]))
            at = z
        words, probabilities = [*words, "\n"], [*probabilities, 10 ** cost[-1]]
        sums = []
        for own in contextmix.OWN:
            for use in (False, True):
                total, tries, hits, seen, after = 0.0, 0, 0, collections.Counter(), {}
                for i, w in enumerate(words):
                    weight = own * i / (i + contextmix.OWN_HALF)
                    p = (1 - weight) * probabilities[i] + weight * (seen[w] / i if i else 0)
                    pair = tuple(words[i - 2 : i]) if i >= 2 else None
                    if use and pair in after:
                        m = min((hits + contextmix.MATCH[0]) / (tries + contextmix.MATCH[1]), 0.98)
                        p = m * (after[pair] == w) + (1 - m) * p
                    if pair in after:
                        tries, hits = tries + 1, hits + (after[pair] == w)
                    if pair:
                        after[pair] = w
                    seen[w] += 1
                    total += math.log10(p)
                sums.append(total)
        want = max(sums) + math.log10(sum(10 ** (x - max(sums)) for x in sums) / len(sums))
        assert got[d] == pytest.approx(want, rel=1e-4, abs=1e-4)


def test_contextmix_next_tokens_sum_to_one(spark):
    """The whole mass of what may come next, the end included, after a text that its own words predict well."""
    import numpy as np

    trained = contextmix.learn(spark.createDataFrame([(1, "a b a b c"), (2, "b a b a")], "doc_id long, text string"))
    for n in (1, 4, 16, 20):
        words = (["a", "b"] * n)[:n]
        text = np.frombuffer(" ".join(words).encode(), np.uint8)
        ended = 10 ** contextmix.text_scores(trained.mixer, *contextmix.streams(text, np.array([0, len(text)])))[0]
        after = {x: _prefix_mass(trained.mixer, [*words, x]) for x in ["a", "b", "c", "d", *"efghijklmnopqrstuvwxyz0123456789.,!", "ab", "zz"]}
        assert ended + sum(after.values()) <= _prefix_mass(trained.mixer, words) * (1 + 1e-9)
        assert n < 16 or ended + after["a"] + after["b"] > 0.5 * _prefix_mass(trained.mixer, words)  # and most of it is here


def _prefix_mass(mixer, words):
    """The probability that a text begins with these words, by the experts' mean, from the definition."""
    import numpy as np

    text = np.frombuffer(" ".join(words).encode(), np.uint8)
    stream, doff, hashes, woff = contextmix.streams(text, np.array([0, len(text)]))
    cost = mixer.log10(contextmix.grams(stream, doff), contextmix.beginnings(stream, doff))
    stops = np.flatnonzero(stream == contextmix.GAP)
    begin = np.concatenate([[0], stops + 1])[: len(stops)]
    coded = np.array([10 ** cost[a : b + 1].sum() for a, b in zip(begin, stops, strict=True)])
    return 10 ** contextmix.experts(hashes, woff, coded, 1)[0]


def test_contextmix_is_the_same_for_any_partitioning(spark, docs, monkeypatch):
    monkeypatch.setattr(contextmix, "BUCKET_BYTES", 1 << 14)  # several buckets
    seen, before = [], spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (4, 9):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            trained = contextmix.learn(docs.repartition(n))
            assert trained.mixer.parts > 1
            seen.append(sorted((str(r.doc_id), r.score) for r in contextmix.score(docs.repartition(n + 1), trained).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1]


def test_contextmix_buckets_hold_the_counts_of_beginnings(spark, docs, monkeypatch):
    """The tables are those of one bucket, but for slots that contexts share."""
    import numpy as np

    monkeypatch.setattr(contextmix, "LEAST_BITS", 22)
    whole = contextmix.learn(docs).mixer
    monkeypatch.setattr(contextmix, "BUCKET_BYTES", 1 << 14)
    parted = contextmix.learn(docs).mixer
    assert whole.parts == 0 and parted.parts > 1 and whole.bits == parted.bits
    at = sum(1 << b for b in whole.bits[:4])
    assert (whole.pairs[:at] == parted.pairs[:at]).all()
    a, b = (np.sort(m.pairs[at:]) for m in (whole, parted))
    assert abs(np.count_nonzero(a) - np.count_nonzero(b)) <= 0.02 * np.count_nonzero(a)


def test_contextmix_keeps_the_ratio_of_large_counts():
    import numpy as np

    n0, n1 = np.array([4e9, 3e6, 9e6, 100, 0]), np.array([1e9, 3e7, 9e3, 7, 0])
    q0, q1 = contextmix.quantised(n0, n1)
    assert contextmix.COUNT[q0[:4]] / contextmix.COUNT[q1[:4]] == pytest.approx(n0[:4] / n1[:4], rel=0.07)
    assert contextmix.COUNT[q0[3]] == pytest.approx(100, rel=0.03) and q0[4] == q1[4] == 0


def test_contextmix_tables_follow_the_contexts():
    import numpy as np

    bits = contextmix.sizes([1 << 10, 1 << 17, 1 << 20, 1 << 30, 1 << 16])
    assert bits == (contextmix.LEAST_BITS, 19, 22, contextmix.MOST_BITS, 18)
    some = np.arange(5000, dtype=np.uint64) * np.uint64(77777)
    rows = list(contextmix.contexts(some, some, bits))
    start = np.cumsum([0] + [1 << b for b in bits])
    for _, slots, _ in rows:
        assert all(lo <= s.min() and s.max() < hi for s, lo, hi in zip(slots, start, start[1:], strict=False))


def test_contextmix_mixer_alone(docs, empty):
    import numpy as np

    trained = contextmix.learn(docs)
    got = contextmix.mixer_alone(docs, trained).first()
    streams = [b"".join(w.encode() + b" " for w in WORD.findall((t or "").translate(LOWER))) + b"\n" for t in texts(docs).values()]
    cost = 0.0
    for s in streams:
        one, ends = np.frombuffer(s, np.uint8), np.array([0, len(s)])
        cost -= trained.mixer.log10(contextmix.grams(one, ends), contextmix.beginnings(one, ends)).sum() / math.log10(2)
    assert got.n_bytes == sum(map(len, streams)) and got.bits_per_byte == pytest.approx(cost / got.n_bytes)
    assert contextmix.mixer_alone(empty, trained).first().n_bytes is None


def test_contextmix_edges(empty, odd):
    assert contextmix.score(empty, contextmix.learn(empty)).isEmpty()
    assert contextmix.score(odd, contextmix.learn(empty)).count() == 4
    assert contextmix.score(odd, contextmix.learn(odd)).filter("score < 0").count() == 4


def test_decontaminate(docs, spark):
    some = texts(docs)
    items = [(1, " ".join(some[3].split()[:14])), (2, "A-b"), (3, ""), (4, None), (5, "no such words here"), (None, "x " * 12), (7, "No Such Words here")]
    got = {r.doc_id: r for r in decontaminate.judge(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    wins = collections.defaultdict(set)
    for k, t in items:
        w = word.findall((t or "").translate(LOWER))
        for i in range(max(len(w) - 9, 1) if w else 0):
            wins[tuple(w[i : i + 10])].add("" if k is None else str(k))
    for d, t in some.items():
        w, hit, found = word.findall((t or "").translate(LOWER)), set(), set()
        for win, ks in wins.items():
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    found |= ks
        want = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
        assert (got[d].n_words, got[d].n_hit, got[d].n_items, got[d].items_sha256, got[d].contaminated) == want


def test_decontaminate_edges(empty, odd, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.judge(empty, none).isEmpty()
    assert decontaminate.judge(odd, none).filter("contaminated").isEmpty()
    near = spark.createDataFrame([(1, "w1 w3")], "item_id long, text string")
    d = spark.createDataFrame([(1, "w3 q w1"), (2, "w3 q q q w1"), (3, "w1")], "doc_id long, text string")
    assert [r.doc_id for r in decontaminate.proximity_matches(d, near, 2).collect()] == [1]


def test_decontaminate_without_broadcast(docs, spark, monkeypatch):
    items = spark.createDataFrame([(1, " ".join(texts(docs)[3].split()[:14]))], "item_id long, text string")
    with_it = sorted(map(tuple, decontaminate.judge(docs, items).collect()))
    monkeypatch.setattr(decontaminate, "BROADCAST_TERMS", 0)
    assert sorted(map(tuple, decontaminate.judge(docs, items).collect())) == with_it


def test_mixing(docs):
    rows = mixing.mix(docs, entropy_fraction=0.95, max_epochs=5.0, block_tokens=500).collect()
    size = {d: len(WORD.findall(t or "")) for d, t in texts(docs).items()}
    assert {r.doc_id for r in rows} == set(size) and all(r.n_tokens == size[r.doc_id] for r in rows)
    by = collections.defaultdict(list)
    for r in rows:
        by[r.source, r.epoch].append(r)
    source = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    for (s, e), part in by.items():
        order = sorted(part, key=lambda r: (hashlib.md5(f"{r.doc_id}:{e}:0".encode()).hexdigest(), r.doc_id))
        at = 0
        for r in order:
            assert r.tokens_before == at and r.block == at // 500
            at += r.n_tokens
        assert len({r.doc_id for r in part}) == len(part)
    used = collections.Counter()
    for r in rows:
        used[r.source] += r.n_tokens
    weights = {r.source: r.weight for r in rows}
    own = collections.Counter()
    for d, s in source.items():
        own[s] += size[d]
    longest = max(size.values())
    for s, budget in {r.source: r.budget_tokens for r in rows}.items():
        assert abs(used[s] - budget) <= longest and used[s] <= 5 * own[s] + longest
    assert sum(weights.values()) == pytest.approx(1)
    h = -sum(w * math.log(w) for w in weights.values() if w)
    assert h >= 0.95 * math.log(len(weights)) - 1e-4 or rows[0].alpha > 0


def test_mixing_edges(empty, odd):
    assert mixing.mix(empty).isEmpty()
    assert mixing.mix(odd).count() == 4
    assert mixing.mix(odd, budget=30).select(F.sum("n_tokens")).first()[0] <= 90


def test_automaton_is_edit_distance():
    import random

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
        return row[-1]

    r = random.Random(1)
    terms = sorted({"".join(r.choice("abc") for _ in range(r.randint(2, 11))) for _ in range(40)})
    a = toxicity.LexiconAutomaton(terms, [])
    for _ in range(3000):
        t = "".join(r.choice("abc") for _ in range(r.randint(1, 12)))
        near = [(distance(t, x), x) for x in terms if distance(t, x) <= toxicity.edits_for(x)]
        got = a.match(t)
        assert (got is None) == (not near)
        if got:
            assert got[1] == min(near)[0] and (got[1], terms[got[0]]) in near
    s = toxicity.LexiconAutomaton(["abcde"], ["vequ"])
    assert s.match("vequoir") == (1, 0) and s.match("veq") is None and s.match("abcdx") == (0, 1)


def test_context():
    text = 'He said "you idiot" to us'
    toks = toxicity.TOKEN.findall(text.lower())
    at = toks.index("idiot")
    assert toxicity.context(text, toks, at, text.index("idiot"), text.index("idiot") + 5) == toxicity.QUOTED
    assert toxicity.context("you idiot", ["you", "idiot"], 1, 4, 9) == toxicity.AIMED
    assert toxicity.context("an idiot", ["an", "idiot"], 1, 3, 8) == toxicity.PLAIN


def test_toxicity(spark):
    import random

    r = random.Random(2)
    rows, labels = [], []
    for i in range(900):
        bad = i % 5 == 0
        w = [f"word{r.randrange(300)}" for _ in range(40)]
        if bad:
            for _ in range(3):
                w[r.randrange(40)] = r.choice(["grumblefish", "snorkwit", "blastoid", "grumblefish!!", "SNORKWIT", "grumblefsh"])
        rows.append((i, " ".join(w), 0))
        labels.append((i, 0, int(bad)))
    rows += [(9000, None, 0), (9001, "", 0), (None, "word1", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    model = toxicity.learn(docs, spark.createDataFrame([*labels, (None, 0, 1), (5, 0, None)], "doc_id long, quality int, toxic int"))
    got = toxicity.score(docs, model).collect()
    assert len(got) == 903 and all(0 <= g.score <= 1 and g.predicted == (g.score >= 0.7) for g in got)
    held = [g for g in got if g.held_out and g.doc_id is not None and g.doc_id < 900]
    assert all(g.predicted == (g.doc_id % 5 == 0) for g in held) and len(held) > 200
    assert all(g.held_out == (zlib.crc32(str(g.doc_id).encode()) % 3 == 1) for g in got if g.doc_id is not None)


def test_toxicity_edges(spark, empty, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.score(empty, toxicity.learn(empty, none)).isEmpty()
    assert toxicity.score(odd, toxicity.learn(odd, none)).filter("predicted = 0").count() == 4


def test_licenses(spark):
    mit = licenses.NOTICES["MIT"][1]
    rows = [(1, f"intro\nReleased under the MIT License.\nReleased under the MIT license!"), (2, mit.upper()), (3, mit[:60]), (4, None), (5, ""), (None, "Licensed under CC BY-NC 4.0."), (7, "MIT " * 5000), (8, "\n".join(mit.split()))]
    got = {r.doc_id: r for r in licenses.judge(spark.createDataFrame(rows, "doc_id long, text string"), licenses.templates(spark)).collect()}
    assert (got[1].n_matches, got[1].licenses, got[1].best_dice) == (2, "MIT", 1.0) and got[2].licenses == "MIT" and got[8].licenses == "MIT"
    assert [got[k].n_matches for k in (3, 4, 5, 7)] == [0] * 4 and got[None].best_license == "CC-BY-NC-4.0"
    assert licenses.judge(spark.createDataFrame([], "doc_id long, text string"), licenses.templates(spark)).isEmpty()
