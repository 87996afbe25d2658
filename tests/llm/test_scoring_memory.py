"""Finding of the third round without a number: what a task of op2_contextmix holds while it scores texts."""

import pickle
import tracemalloc

import numpy as np
import pyarrow as pa

from pagequarry.llm import contextmix


def test_texts_are_scored_in_little_memory():
    r = np.random.default_rng(1)
    texts = [" ".join(f"w{x:x}" for x in r.integers(0, 1 << 20, 2000)) for _ in range(200)]  # 2.6 MB
    n = len(texts)
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(range(n)), pa.array([False] * n), pa.array(texts)], ["rid", "doc_id", "held_out", "text"])
    model = (contextmix.blank(), (np.zeros(0, np.uint64), np.zeros(0, np.int64)), 0)
    tracemalloc.start()
    try:
        assert sum(b["rid"].null_count == 0 for b in contextmix._score(model, iter([batch]))) > 0
        assert tracemalloc.get_traced_memory()[1] < 150 << 20
    finally:
        tracemalloc.stop()


def test_a_received_mixer_is_the_one_sent_and_holds_its_tables_alone():
    r = np.random.default_rng(2)
    sent = contextmix.blank((16, 17, 18, 16, 20), 4)
    sent.pairs[:], sent.checks[:] = r.integers(0, 1 << 16, len(sent.pairs)), r.integers(0, 256, len(sent.checks))
    data = pickle.dumps(sent)
    tracemalloc.start()
    try:
        got = pickle.loads(data)
        held = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert all(np.array_equal(a, b) for a, b in zip(sent[:4], got[:4], strict=True)) and got[4:] == sent[4:]
    assert held < 3.2 * len(sent.pairs)


def test_coded_by_parts_the_costs_are_the_same(monkeypatch):
    r = np.random.default_rng(3)
    mixer = contextmix.blank((16,) * 5)
    mixer.pairs[:] = r.integers(0, 1 << 16, len(mixer.pairs))
    g, w = r.integers(0, 1 << 40, 1000).astype(np.uint64), r.integers(0, 1 << 48, 1000).astype(np.uint64)
    whole = mixer.log10(g, w)
    monkeypatch.setattr(contextmix, "CODED", 64)
    assert np.allclose(whole, mixer.log10(g, w), rtol=1e-9, atol=0)
