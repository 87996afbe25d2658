"""Findings of the third round: what workers hold while they hash words (pipeline) and pack buckets (op2_contextmix)."""

import tracemalloc

import numpy as np
import pyarrow as pa

from pagequarry.llm import contextmix, substrings
from pagequarry.llm import textkernel as tk


def peak(run) -> int:
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] >> 20
    finally:
        tracemalloc.stop()


def test_paths_of_a_batch_take_little_memory():
    r = np.random.default_rng(1)
    texts = [" ".join(f"w{x:x}" for x in r.integers(0, 1 << 20, 2000)) for _ in range(300)]  # 4 MB
    batch = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array([0] * 300), pa.array(texts)], ["id", "twin", "text"])
    assert peak(lambda: sum(b.num_rows for b in substrings._paths(iter([batch])))) < 60  # 100 MB before


def test_word_beginnings_are_packed_bit_by_bit():
    r = np.random.default_rng(1)
    n = 100_000
    g, w, c = r.integers(0, 1 << 40, n).astype(np.uint64), r.integers(0, 50000, n).astype(np.uint64) << np.uint64(8), r.integers(1, 50, n)
    assert peak(lambda: contextmix._begun(g, w, c, 23, 3)) < 75  # 84 MB before
    none = np.zeros(0, np.uint64)
    assert [len(x) for x in contextmix._begun(none, none, none.astype(np.int64), 23, 3)] == [0, 0, 0, 0]


def test_chunks_of_a_column_are_its_texts():
    texts = ["ab", None, "", "x" * 50, "é", None]
    for column in (pa.array(texts), pa.array(["?", *texts])[1:], pa.chunked_array([texts[:2], texts[2:]]), pa.array([None, None], pa.string()), pa.array([], pa.string())):
        got = [bytes(buf[a:b]) for _, _, buf, off in tk.chunks(column, 10) for a, b in zip(off[:-1], off[1:], strict=True)]
        assert got == [(x.as_py() or "").encode() for x in column]
