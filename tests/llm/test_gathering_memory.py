"""Findings of the third round: what a task of op2_contextmix holds while it counts contexts."""

import tracemalloc

import numpy as np
import pyarrow as pa

from pagequarry.llm import contextmix


def test_contexts_are_gathered_in_little_memory():
    r = np.random.default_rng(1)
    texts = [" ".join(f"w{x:x}" for x in r.integers(0, 1 << 20, 2000)) for _ in range(220)]  # 3 MB
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    tracemalloc.start()
    try:
        assert sum(b.num_rows for b in contextmix._gather(2)(iter([batch]))) == 9
        assert tracemalloc.get_traced_memory()[1] < 170 << 20  # 233 MB before
    finally:
        tracemalloc.stop()


def test_merged_counts():
    r = np.random.default_rng(2)
    parts = [(r.integers(0, 50, 200).astype(np.uint64), np.zeros(200, np.uint64), r.integers(1, 9, 200)) for _ in range(3)]
    want: dict[int, int] = {}
    for key, _, n in parts:
        for k, c in zip(key.tolist(), n.tolist(), strict=True):
            want[k] = want.get(k, 0) + c
    for coded in (True, False):
        key, _, n = contextmix._merge(list(parts), coded)
        assert dict(zip(key.tolist(), n.tolist(), strict=True)) == want
    none = np.zeros(0, np.uint64)
    assert [len(x) for x in contextmix._merge([(none, none, none.astype(np.int64))], True)] == [0, 0, 0]
