"""Vectorised tokenising and hashing of text batches with numpy.

Texts are laid out as one byte buffer with document offsets.  Word and window
hashes come from prefix sums of a polynomial modulo 2**64 with odd bases, so a
hash of any span costs one subtraction and one multiplication; the cost is a
few nanoseconds a byte and there is no Python loop over words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: bytes of text that are worked on at once: what their arrays take is some fifty times as much
CHUNK_BYTES = 500_000

_BYTE_BASE = np.uint64(0x9E3779B97F4A7C13)
_WORD_BASE = np.uint64(0xC2B2AE3D27D4EB4B)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

#: words are runs of anything but the bytes 0x20 and 0x09-0x0D
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads every input bit over the output."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 1 << 64))


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: np.uint64):
        self.base, self.inv = base, _inverse(base)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, CHUNK_BYTES + 1)
            for name, b in (("up", self.base), ("down", self.inv)):
                a = np.full(size, b, np.uint64)
                a[0] = 1
                setattr(self, name, np.cumprod(a, dtype=np.uint64))
        return self.up[:n], self.down[:n]


_BYTES, _WORDS = _Powers(_BYTE_BASE), _Powers(_WORD_BASE)
_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows of about limit bytes; only these are laid out at a time."""
    size = pc.fill_null(pc.binary_length(column.cast(pa.string()) if pa.types.is_null(column.type) else column), 0)
    off = np.concatenate([[0], np.cumsum(size.to_numpy(zero_copy_only=False) if isinstance(size, pa.Array) else size.to_numpy(), dtype=np.int64)])
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j, *buffer_of(column.slice(i, j - i))
        i = j
    give_back()


_LIBC = ctypes.CDLL(None)


def give_back() -> None:
    """Freed memory goes back to the machine: a worker is used again by other tasks, and what it keeps counts as its executor's."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def word_spans(buf: np.ndarray, off: np.ndarray, gaps: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the word offsets of the documents; gaps tells of each byte whether it stands between words."""
    n = len(buf)
    ink = ~gaps[buf]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before = np.empty(n, bool)
    after = np.empty(n, bool)
    if n:
        before[0], before[1:] = False, ink[:-1]
        after[-1], after[:-1] = False, ink[1:]
    starts = np.flatnonzero(ink & (~before | edge[:-1]))
    ends = np.flatnonzero(ink & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    up, down = _BYTES.upto(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE_VALUE[buf] * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] ^ (ends - starts).astype(np.uint64) * _M2)


def windows(hashes: np.ndarray, woff: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the k words from each position (any value where they don't fit), and whether they fit in one document."""
    n = len(hashes)
    up, down = _WORDS.upto(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * up[:n], out=sums[1:])
    out = np.zeros(n, np.uint64)
    if n >= k:
        out[: n - k + 1] = mix((sums[k:] - sums[:-k]) * down[: n - k + 1] + np.uint64(k))
    fits = np.zeros(n + 1, np.int32)
    lo, hi = woff[:-1], np.maximum(woff[:-1], woff[1:] - k + 1)
    np.add.at(fits, lo, 1)
    np.add.at(fits, hi, -1)
    return out, np.cumsum(fits[:n]) > 0


def spans_hash(hashes: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hash of each word span lo..hi."""
    n = len(hashes)
    up, down = _WORDS.upto(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * up[:n], out=sums[1:])
    return mix((sums[hi] - sums[lo]) * down[lo] + (hi - lo).astype(np.uint64) * _M1)


def doc_of(woff: np.ndarray) -> np.ndarray:
    """The document index of every word."""
    return np.repeat(np.arange(len(woff) - 1), np.diff(woff))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
