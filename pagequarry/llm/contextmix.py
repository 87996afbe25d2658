"""Language-model scores by logistic context mixing, beside a unigram base score.

Tokens are coded as bytes (A-Z in lower case, each word followed by a space, a
line feed as the end), bit by bit.  For each bit, `PREDICTORS` predictors look
up how often it was 0 and 1 before: after the last 1, 2, 3 and 4 bytes, and
after the beginning of the same word, each together with the byte's earlier
bits.  The last of them follows the words' counts: multiplied over a word's
bits, its frequencies are the word's share among the training tokens.  The
tables are hashed, their sizes follow the number of distinct contexts, up to
2**`MOST_BITS` slots; of several contexts of a slot, the one seen most often keeps
it, which a check of eight bits tells, and the others count as new.  A count is kept in
a byte, as its logarithm in steps of 1/`STEPS` of a doubling; where the larger of
a slot's two counts is over the greatest of these values, both are halved
together until it fits, so that their ratio stays.  The predictors' log odds are
combined with weights from a set that a gate selects by how much the context of
four bytes and the word's beginning have been seen, and a table of levels
refines the mixed probability.

While a text is scored, its own words refine this further: experts take the
mixer's probability of each token alone, or mixed with the token's share in the
text so far (`OWN`), or with what followed the same two words when they last
stood in it, weighted by its success so far.  The end is a token among the
others, which a text's own words take from as well.  The experts begin with equal
weights, which follow their success in the text (Bayes' rule), so that the score
is the logarithm of the mean of the experts' products.  Every bit's two
probabilities add up to one, and so do the experts' weights: what may come next,
any word or the end, has a total of one at most, and so have all texts.

Learning is online in each of its parts and distributed over the corpus:
predictors learn with the rate 1/n, which makes their state the counts of both
bits, so that tasks' counts just add up; weights are trained by online gradient
steps over the distinct contexts of each bucket, each bit left out of its own
counts, and the buckets' weights are averaged by the number of bits; the refining
table is again counts.  All training documents are read.  Buckets follow from the
size of the texts and from the contexts, never from Spark's partitions, so that
the model is the same for any number of these.  A text's score depends on the
model and itself alone, not on what stands beside it.

Contexts are shuffled once: tasks send each distinct byte with its contexts to its
bucket, one row of which then holds all of the bucket's.  Where the last bytes lie
in the same word, the bucket is that of the word's beginning, whose counts are
thus complete in it, and so are those of the slots of its part of their table; the
shorter contexts, which are few, are added up by a second, small shuffle.

The base score is the sum of log10((c + 0.1) / (N + 0.1 * (V + 1))) over the
tokens, c being a token's count in the training documents.  The counts of the
`FREQUENT` most frequent words are broadcast (a fixed number); all others meet
the documents' words in a join by the word's 64-bit hash, so that the
vocabulary stays distributed.

Nulls and edges: a null or empty text is its end alone.  Texts of any length are
scored whole.  Rows that repeat a doc_id or a text are scored each.  A null
doc_id counts as the empty text for the folds.  With no training documents every
count is 0; empty tables give empty tables.  Columns besides doc_id and text are
not read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import fold, stored

ORDERS = 4
#: a predictor for each order, and one for the word's beginning
PREDICTORS = ORDERS + 1
#: slots of the table by which `distinct` finds repeats, and of each order's table before anything is learnt
SLOT_BITS = 21
#: bounds of the slots of an order's table, and the slots for each distinct gram that it codes
LEAST_BITS, MOST_BITS, ROOM = 16, 23, 4
#: steps of a doubling in which counts are kept
STEPS = 12
#: grams whose bits are counted at once
BLOCK = 1 << 17
#: grams whose bits are coded at once
CODED = 1 << 16
FREQUENT = 1 << 16
#: bytes of text that are scored at once, of which a task holds some hundred bytes each
CHUNK = 500_000
#: bytes of text whose contexts a task counts at once, of which it holds some two hundred bytes each
GATHER = 1 << 20
END, GAP = 0x0A, 0x20
DELTA = 0.05
#: distinct contexts of a training step, and the curvature that a gate's first weights count for
STEP, STIFF = 4096, 50.0
EDGES = np.array([1, 3, 12, 100])  # sightings at which a context counts as better known
GATES = (len(EDGES) + 1) ** 2
LEVELS = 33
FLOOR = 1e-6
KEEP = 1_000_000
#: bytes of text for a bucket of contexts (rounded to a power of two of buckets), and for each gram that the table of word beginnings has room for
BUCKET_BYTES, BYTES_A_GRAM = 8 << 20, 8
#: stands for a text's end among the hashes of its words
END_TOKEN = np.uint64(0xE2D0E2D0E2D0E2D1)
#: what experts give to the text's own words at most, the tokens after which it is half of that, and the match predictor's first success
OWN, OWN_HALF, MATCH = (0.0, 0.1, 0.4), 60, (0.02, 1.0)


def streams(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes to code, their document offsets, word hashes, word offsets) of lower-cased documents."""
    buf = tk.LOWER[buf]
    starts, ends, woff = tk.word_spans(buf, off)
    size = ends - starts + 1
    total = np.concatenate([[0], np.cumsum(size)])
    length = total[woff[1:]] - total[woff[:-1]] + 1
    doff = np.concatenate([[0], np.cumsum(length)])
    out = np.full(doff[-1], END, np.uint8)
    doc = tk.doc_of(woff)
    at = doff[doc] + total[:-1] - total[woff[doc]]
    src = np.arange(total[-1]) + np.repeat(starts - total[:-1], size)
    dst = np.arange(total[-1]) + np.repeat(at - total[:-1], size)
    gap = total[1:] - 1
    value = buf[np.minimum(src, max(len(buf) - 1, 0))] if len(buf) else np.zeros(0, np.uint8)
    value[gap] = GAP
    out[dst] = value
    return out, doff, tk.word_hashes(buf, starts, ends), woff


def grams(stream: np.ndarray, doff: np.ndarray) -> np.ndarray:
    """Each byte with the ORDERS bytes before it (line feeds before a document's start), packed."""
    place = np.arange(len(stream)) - np.repeat(doff[:-1], np.diff(doff))
    out = stream.astype(np.uint64)
    for k in range(1, ORDERS + 1):
        before = np.full(len(stream), END, np.uint64)
        before[k:] = stream[:-k] if k < len(stream) else stream[:0]
        before[place < k] = END
        out |= before << np.uint64(8 * k)
    return out


def beginnings(stream: np.ndarray, doff: np.ndarray) -> np.ndarray:
    """Each byte with a hash of the bytes of its word before it: 40 bits of hash and 8 of the byte."""
    n = len(stream)
    start = np.zeros(n, bool)
    start[doff[:-1][doff[:-1] < n]] = True
    start[1:] |= stream[:-1] == GAP
    at = np.maximum.accumulate(np.where(start, np.arange(n), 0))
    return tk.word_hashes(stream, at, np.arange(n)) >> np.uint64(24) << np.uint64(8) | stream


def distinct(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct value, and for each value its number among them, by a table of the last holder of each hash."""
    n = len(g)
    slot = (tk.mix(g) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
    table = np.zeros(1 << SLOT_BITS, np.int32)
    table[slot] = np.arange(n, dtype=np.int32)
    holder = table[slot]
    same = g[holder] == g
    mark = np.zeros(n, bool)
    mark[holder[same]] = True
    first = np.flatnonzero(mark)
    where = np.cumsum(mark) - 1
    inverse = where[holder]
    rest = np.flatnonzero(~same)
    if not len(rest):
        return first, inverse
    _, at, back = np.unique(g[rest], return_index=True, return_inverse=True)
    inverse[rest] = len(first) + back
    return np.concatenate([first, rest[at]]), inverse


def deep(g: np.ndarray) -> np.ndarray:
    """Whether all of the ORDERS bytes before lie in the byte's own word."""
    out = np.ones(len(g), bool)
    for k in range(1, ORDERS + 1):
        before = g >> np.uint64(8 * k) & np.uint64(0xFF)
        out &= (before != GAP) & (before != END)
    return out


def bases(g: np.ndarray, w: np.ndarray) -> list[np.ndarray]:
    """A hash of each predictor's context."""
    return [tk.mix((g >> np.uint64(8) & np.uint64((1 << 8 * o) - 1)) + np.uint64(o << 40)) for o in range(1, ORDERS + 1)] + [tk.mix((w >> np.uint64(8)) + np.uint64(0x77 << 56))]


def top(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The first bits of hashes."""
    return (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)


def nodes(byte: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each of the eight bits: the byte's bits before it, and the bit."""
    for i in range(8):
        yield np.uint64(1 << i) | byte >> np.uint64(8 - i), (byte >> np.uint64(7 - i) & np.uint64(1)).astype(np.int8)


def place(base: np.ndarray, node: np.ndarray, bits: int, parts: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """A context's slot in a table of 2**bits slots, and its check; with parts, all slots of a context are in one of 2**parts parts of the table."""
    h = (base + node * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93)
    return top(base, parts) << (bits - parts) | top(h, bits - parts), (tk.mix(h) >> np.uint64(56)).astype(np.uint8)


def contexts(g: np.ndarray, w: np.ndarray, bits: tuple[int, ...] = (SLOT_BITS,) * PREDICTORS, parts: int = 0) -> Iterator[tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]]:
    """For each of the eight bits of `grams` and their `beginnings`: the bit, and for each predictor its slot in the tables of 2**bits slots that lie one behind the other, and its check; the last table is in 2**parts parts."""
    own, start = bases(g, w), np.concatenate([[0], np.cumsum([1 << b for b in bits])])
    for node, bit in nodes(g & np.uint64(0xFF)):
        both = [place(b, node, bits[o], parts if o == ORDERS else 0) for o, b in enumerate(own)]
        yield bit, [start[o] + s for o, (s, _) in enumerate(both)], [c for _, c in both]


COUNT = (2 ** (np.arange(256) / STEPS) - 1).astype(np.float32)


#: of both counts' steps (n0 << 8 | n1): the log odds, and how well the context is known; as they are, and with a bit 0 or 1 left out of its own counts
_N = [COUNT[np.arange(1 << 16) >> 8], COUNT[np.arange(1 << 16) & 255]]
# counts in the last doubling may have been halved; one sighting more or less says nothing there
_FEW = np.maximum(*_N) < COUNT[255 - STEPS]
_LEFT = [[np.maximum(n - (_FEW & (leave == k)), 0) for k, n in enumerate(_N)] for leave in (None, 0, 1)]
LOG_ODDS = np.concatenate([np.log((b + DELTA) / (a + DELTA)) for a, b in _LEFT]).astype(np.float32)
KNOWN = np.concatenate([np.searchsorted(EDGES, a + b, "right") for a, b in _LEFT]).astype(np.int64)


def quantised(n0: np.ndarray, n1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both counts as steps of their logarithm, in a byte each; counts beyond the last step are halved together until they fit."""
    most = np.maximum(np.maximum(n0, n1), 1).astype(np.float64)
    half = 0.5 ** np.maximum(np.ceil(np.log2(most / (2 ** (255 / STEPS) - 1))), 0)
    return tuple(np.clip(np.rint(STEPS * np.log2(1 + n * half)), 0, 255).astype(np.uint8) for n in (n0, n1))


def sizes(grams_: list[int]) -> tuple[int, ...]:
    """The bits of each order's table for that many distinct grams."""
    return tuple(min(max(int(np.ceil(np.log2(ROOM * max(n, 1)))), LEAST_BITS), MOST_BITS) for n in grams_)


class Mixer(NamedTuple):
    """The finished model: both counts of every slot (as `quantised`, n0 << 8 | n1) and its check, the weights of each gate, the refining table, the bits of each predictor's table, and of the last one's parts."""

    pairs: np.ndarray
    checks: np.ndarray
    weights: np.ndarray
    refine: np.ndarray
    bits: tuple[int, ...]
    parts: int = 0

    def packed(self) -> tuple:
        """The same, small enough to send: tables that are mostly empty compress well."""
        return (*(zlib.compress(x.tobytes(), 1) for x in ((self.pairs >> 8).astype(np.uint8), self.pairs.astype(np.uint8), self.checks)), *self[2:])

    @staticmethod
    def unpacked(x: tuple) -> Mixer:
        pairs = np.frombuffer(zlib.decompress(x[0]), np.uint8).astype(np.uint16)
        pairs <<= 8
        pairs |= np.frombuffer(zlib.decompress(x[1]), np.uint8)
        return Mixer(pairs, np.frombuffer(zlib.decompress(x[2]), np.uint8), *x[3:])

    def __reduce__(self) -> tuple:
        """Sent packed; who receives it holds the tables alone, however many of its tasks read them."""
        return Mixer.unpacked, (self.packed(),)

    def inputs(self, slots: list[np.ndarray], checks: list[np.ndarray], leave: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Log odds of each predictor (and a constant), and the gate; leave: bits to be left out of their own counts."""
        n = len(slots[0])
        x = np.empty((PREDICTORS + 1, n), np.float32)
        gate = np.zeros(n, np.int64)
        variant = 0 if leave is None else (leave.astype(np.int32) + 1) << 16
        for o, (s, check) in enumerate(zip(slots, checks, strict=True)):
            # else the slot belongs to a context seen more often, and this one counts as new
            at = np.where(self.checks[s] == check, self.pairs[s], 0).astype(np.int32) + variant
            x[o] = LOG_ODDS[at]
            if o >= PREDICTORS - 2:
                gate = gate * (len(EDGES) + 1) + KNOWN[at]
        x[PREDICTORS] = 0.3
        return x, gate

    def mix(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        return np.einsum("on,no->n", x, self.weights[gate])

    def refined(self, st: np.ndarray, gate: np.ndarray) -> np.ndarray:
        """Probability of a 1: the mean of the mixed one and the refining table's, interpolated between its levels."""
        at = np.clip(st + (LEVELS - 1) / 4 * 1.0, 0, LEVELS / 2 - 0.501) * 2
        lo = np.minimum(at.astype(np.int64), LEVELS - 2)
        part = at - lo
        p = self.refine[gate, lo] * (1 - part) + self.refine[gate, lo + 1] * part
        return np.clip((1 / (1 + np.exp(-st)) + p) / 2, FLOOR, 1 - FLOOR)

    def log10(self, g: np.ndarray, w: np.ndarray) -> np.ndarray:
        """log10 probability of each byte (`grams` and `beginnings`) after its contexts."""
        out = np.ones(len(g))
        for lo in range(0, len(g), CODED):
            part = out[lo : lo + CODED]
            for bit, slots, checks in contexts(g[lo : lo + CODED], w[lo : lo + CODED], self.bits, self.parts):
                x, gate = self.inputs(slots, checks)
                p = self.refined(self.mix(x, gate), gate)
                part *= np.where(bit, p, 1 - p)
        return np.log10(out)  # FLOOR**8 at least


class Memo:
    """Costs of bytes with their contexts that a task has worked out, KEEP at most: then it starts anew."""

    def __init__(self) -> None:
        self.codes, self.costs = np.zeros(0, np.uint64), np.zeros(0)

    def of(self, mixer: Mixer, g: np.ndarray, w: np.ndarray) -> np.ndarray:
        """`Mixer.log10` of distinct bytes."""
        code = code_of(g, w)
        at = np.searchsorted(self.codes, code)
        known = self.codes[np.minimum(at, len(self.codes) - 1)] == code if len(self.codes) else np.zeros(len(code), bool)
        out = np.empty(len(g))
        out[known] = self.costs[at[known]]
        new = np.flatnonzero(~known)
        out[new] = mixer.log10(g[new], w[new])
        if len(self.codes) + len(new) > KEEP:
            self.codes, self.costs = np.zeros(0, np.uint64), np.zeros(0)
            at = np.zeros(len(code), np.int64)
        order = new[np.argsort(code[new], kind="stable")]
        self.codes, self.costs = (np.insert(old, at[order], x) for old, x in ((self.codes, code[order]), (self.costs, out[order])))
        return out


def level_of(st: np.ndarray) -> np.ndarray:
    return np.clip(np.rint((st + (LEVELS - 1) / 4) * 2), 0, LEVELS - 1).astype(np.int64)


def blank(bits: tuple[int, ...] = (SLOT_BITS,) * PREDICTORS, parts: int = 0) -> Mixer:
    st = np.arange(LEVELS) / 2 - (LEVELS - 1) / 4
    slots = sum(1 << b for b in bits)
    return Mixer(np.zeros(slots, np.uint16), np.zeros(slots, np.uint8), np.tile(np.array([0.05, 0.1, 0.15, 0.3, 0.4, 0], np.float32), (GATES, 1)), np.tile((1 / (1 + np.exp(-st))).astype(np.float32), (GATES, 1)), bits, parts)


GATHERED = "kind int, bucket int, rows long, key binary, began binary, n binary"
PACKED = "bucket int, rows long, keys binary, began binary, counts binary, types long, words binary, word_counts binary, ends long, slots binary, checks binary, zeros binary, ones binary"


def planes(x: np.ndarray, width: int = 0) -> bytes:
    """Whole numbers as their first bytes, then their second ones, and so on, `width` or as many as they take, which compresses well."""
    width = width or (max(int(x.max(initial=0)), 1).bit_length() + 7) // 8
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def whole(data: bytes, rows: int) -> np.ndarray:
    """The numbers of `planes`."""
    out = np.zeros((rows, 8), np.uint8)
    if rows:
        x = np.frombuffer(data, np.uint8).reshape(-1, rows)
        out[:, : len(x)] = x.T
    return out.view("<u8").reshape(-1)


def _merge(parts: list[tuple[np.ndarray, ...]], coded: bool) -> tuple[np.ndarray, ...]:
    """Parts (key, began, n), which it empties, as one, with the counts of equal codes (keys, if they aren't coded) added up, by code."""
    key, began, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    parts.clear()
    code = code_of(key, began) if coded else key
    order = np.argsort(code, kind="stable")
    code = code[order]
    start = np.flatnonzero(np.concatenate([[len(code) > 0], code[1:] != code[:-1]]))
    del code
    first = order[start]
    return key[first], began[first], np.add.reduceat(n[order], start).astype(np.int64) if len(start) else n.astype(np.int64)


def code_of(g: np.ndarray, w: np.ndarray) -> np.ndarray:
    """One value for a byte's contexts of all predictors."""
    return tk.mix(w) ^ g


def bucket_of(g: np.ndarray, w: np.ndarray, parts: int) -> np.ndarray:
    """The bucket of a byte: that of its word's beginning where all its context lies in the word, so that such a beginning's bytes are together; else that of the whole context, so that common beginnings are not."""
    return np.where(deep(g), top(bases(g, w)[ORDERS], parts), top(tk.mix(code_of(g, w)), parts))


KINDS = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]


def _gather(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of a task's bytes with their contexts (kind 0) and words (kind 1), a row for each bucket, and its number of ends (kind 2)."""
        held: dict[int, list] = {0: [], 1: []}
        names = [x.split()[0] for x in GATHERED.split(", ")]
        ends = 0

        def out(kind: int) -> Iterator[pa.RecordBatch]:
            k, w, n = _merge(held[kind], kind == 0)
            if not len(k):
                return
            bucket = bucket_of(k, w, parts) if kind == 0 else top(tk.mix(k), parts)
            order = np.argsort(bucket, kind="stable")
            bucket, k, w, n = (x[order] for x in (bucket, k, w, n))
            edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])).tolist()
            rows = [(kind, int(bucket[a]), b - a, planes(k[a:b], 5 if kind == 0 else 8), planes(w[a:b] >> np.uint64(8), 5) if kind == 0 else b"", planes(n[a:b])) for a, b in zip(edge[:-1], edge[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(zip(*rows, strict=True), KINDS, strict=True)], names)

        for b in batches:
            for i, j, buf, off in tk.chunks(b["text"], GATHER):
                stream, doff, words, _ = streams(buf, off)
                ends += j - i
                g, w = grams(stream, doff), beginnings(stream, doff)
                for kind, code, key, began in ((0, code_of(g, w), g, w), (1, words, words, np.zeros(len(words), np.uint8))):
                    first, inverse = distinct(code)
                    held[kind].append((key[first], began[first], np.bincount(inverse, minlength=len(first))))
                    if sum(len(x[0]) for x in held[kind]) > KEEP:
                        held[kind] = [_merge(held[kind], kind == 0)]
                        if len(held[kind][0][0]) > KEEP // 2:
                            yield from out(kind)
        for kind in (0, 1):
            if held[kind]:
                yield from out(kind)
        if ends:
            yield pa.RecordBatch.from_arrays([pa.array([x], y) for x, y in zip((2, 0, ends, b"", b"", b""), KINDS, strict=True)], names)

    return run


def _by_slot(slots: np.ndarray, checks: np.ndarray, bit: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """(slot, check, n0, n1) of each slot's and check's sightings."""
    u, inverse = np.unique(slots << 8 | checks, return_inverse=True)
    n1 = np.bincount(inverse, bit * n, len(u)).astype(np.int64)
    return u >> 8, (u & 0xFF).astype(np.uint8), np.bincount(inverse, n, len(u)).astype(np.int64) - n1, n1


def _added(key: np.ndarray, *counts: np.ndarray) -> list[np.ndarray]:
    """The keys in order, once each, with their counts added up."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    start = np.flatnonzero(np.concatenate([[len(key) > 0], key[1:] != key[:-1]]))
    return [key[start], *(np.add.reduceat(c[order], start) if len(start) else c[:0] for c in counts)]


def _begun(g: np.ndarray, w: np.ndarray, n: np.ndarray, bits: int, parts: int) -> tuple[np.ndarray, ...]:
    """The table of the word's beginning, of bytes that all lie in its parts: each slot with the context that was seen most often."""
    base, found = bases(g, w)[ORDERS], []
    for node, bit in nodes(g & np.uint64(0xFF)):  # one bit of the bytes at a time: all eight would be eight times as long
        slot, check = place(base, node, bits, parts)
        found.append(_added((slot << 8 | check.astype(np.int64)).astype(np.uint32), n, n * bit))  # a slot has MOST_BITS at most
    del base, slot, check
    key, both, n1 = _added(*(np.concatenate(x) for x in zip(*found, strict=True)))
    del found
    slot, check, n0 = key.astype(np.int64) >> 8, (key & 0xFF).astype(np.uint8), both - n1
    order = np.lexsort((check, n0 + n1, slot))
    last = np.append(np.diff(slot[order]) != 0, True) if len(order) else np.zeros(0, bool)
    k = order[last]
    return slot[k].astype(np.int32), check[k], *quantised(n0[k], n1[k])


def _pack(bits: int, parts: int):
    def run(table: pa.Table) -> pa.Table:
        """A bucket's distinct bytes with their contexts, its words, and its part of the table of word beginnings, as one row."""
        parts_: dict[int, list] = {0: [], 1: []}
        ends, none = 0, np.zeros(0, np.uint64)
        for b in table.to_batches():
            for kind, rows, key, began, n in zip(*(b[c].to_pylist() for c in ("kind", "rows", "key", "began", "n")), strict=True):
                if kind == 2:
                    ends += rows
                    continue
                k, w, c = whole(key, rows), whole(began, rows) if kind == 0 else none, whole(n, rows).astype(np.int64)
                w = w << np.uint64(8) | k & np.uint64(0xFF) if kind == 0 else np.zeros(rows, np.uint8)
                parts_[kind].append((k, w, c))
        blank_ = (none, none, none.astype(np.int64))
        g, w, counts = _merge(parts_[0] or [blank_], True)
        words, _, word_counts = _merge(parts_[1] or [blank_], False)
        d = deep(g)
        made = _begun(g[d], w[d], counts[d], bits, parts)
        names = [x.split()[0] for x in PACKED.split(", ")]
        del d
        row = [table["bucket"][0].as_py(), len(g), planes(g, 5), planes(w >> np.uint64(8), 5), planes(counts), len(words), planes(words, 8), planes(word_counts), ends, *(x.tobytes() for x in made)]
        kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 3, pa.int64(), *[pa.binary()] * 2, pa.int64(), *[pa.binary()] * 4]
        packed = pa.Table.from_arrays([pa.array([x], y) for x, y in zip(row, kinds, strict=True)], names)
        del row, made, g, w, counts, words, word_counts
        tk.give_back()
        return packed

    return run


def _rows(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The bytes of each bucket: keys, began, counts."""
    for i in range(b.num_rows):
        n = b["rows"][i].as_py()
        g, w, counts = (whole(b[c][i].as_buffer(), n) for c in ("keys", "began", "counts"))
        yield g, w << np.uint64(8) | g & np.uint64(0xFF), counts.astype(np.int64)


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(b.num_rows):
            word, c = (whole(b[x][i].as_buffer(), b["types"][i].as_py()) for x in ("words", "word_counts"))
            yield pa.RecordBatch.from_arrays([pa.array(tk.signed(word)), pa.array(c.astype(np.int64))], ["word", "c"])


def _orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bucket's bytes after each order's context, and those at a word's first bytes after its beginning (predictor ORDERS)."""
    for b in batches:
        for g, w, n in _rows(b):
            d = ~deep(g)
            for o, key, count in [(o, g & np.uint64((1 << 8 * (o + 2)) - 1), n) for o in range(ORDERS)] + [(ORDERS, w[d], n[d])]:
                u, inverse = np.unique(key, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), o, np.int32)), pa.array(tk.signed(u)), pa.array(np.bincount(inverse, count, len(u)).astype(np.int64))], ["predictor", "key", "n"])


def _tally(bits: tuple[int, ...], parts: int):
    start = np.concatenate([[0], np.cumsum([1 << b for b in bits])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of both bits by slot and check."""
        for b in batches:
            predictor, key, n = b["predictor"].to_numpy(), b["key"].to_numpy().view(np.uint64), b["n"].to_numpy()
            for o in np.unique(predictor):
                k, count = key[predictor == o], n[predictor == o]
                base = bases(k, k)[o]  # an order's context stands before the byte in its key, as a beginning does in its own
                rows = [(*place(base, node, bits[o], parts if o == ORDERS else 0), bit) for node, bit in nodes(k & np.uint64(0xFF))]
                slot, check, n0, n1 = _by_slot(start[o] + np.concatenate([s for s, _, _ in rows]), np.concatenate([c for _, c, _ in rows]), np.concatenate([x for _, _, x in rows]), np.tile(count, 8))
                yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(check.astype(np.int32)), pa.array(n0), pa.array(n1)], ["slot", "check", "n0", "n1"])

    return run


def _shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slots with their checks and both counts as `quantised`."""
    for b in batches:
        q0, q1 = quantised(b["n0"].to_numpy(), b["n1"].to_numpy())
        yield pa.RecordBatch.from_arrays([b["slot"].cast(pa.int32()), pa.array(b["check"].to_numpy().astype(np.uint8).view(np.int8)), pa.array(q0.view(np.int8)), pa.array(q1.view(np.int8))], ["slot", "check", "q0", "q1"])


def _train(model: Mixer):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each bucket's weights after an online pass over its bytes, and the weight of what it saw.

        Each step moves a gate's weights along its gradient, scaled by the inverse of the curvature of all that the gate has seen so far.
        """
        for b in batches:
            for bucket, (g, w, n) in zip(b["bucket"].to_pylist(), _rows(b), strict=True):
                if len(g):
                    yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([_trained(model, g, w, n).tobytes()], pa.binary()), pa.array([float(n.sum())])], ["bucket", "w", "n"])

    return run


def _trained(model: Mixer, g: np.ndarray, began: np.ndarray, counts: np.ndarray) -> np.ndarray:
    w = model.weights.astype(np.float64)
    curve = np.tile(np.eye(PREDICTORS + 1) * STIFF, (GATES, 1, 1))
    for lo in range(0, len(g), STEP):
        n = counts[lo : lo + STEP].astype(np.float64)
        for bit, slots, checks in contexts(g[lo : lo + STEP], began[lo : lo + STEP], model.bits, model.parts):
            x, gate = model.inputs(slots, checks, bit)
            x = x.astype(np.float64)
            p = 1 / (1 + np.exp(-np.clip(np.einsum("on,no->n", x, w[gate]), -30, 30)))
            err, steep = (bit - p) * n, np.maximum(p * (1 - p), 1e-4) * n
            by_gate = np.argsort(gate, kind="stable")
            edges = np.searchsorted(gate[by_gate], np.arange(GATES + 1))
            for k in np.flatnonzero(np.diff(edges)):
                m = by_gate[edges[k] : edges[k + 1]]
                curve[k] += (x[:, m] * steep[m]) @ x[:, m].T
                w[k] += np.linalg.solve(curve[k], x[:, m] @ err[m])
    return w


def _calibrate(model: Mixer):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How often bits were 1 at each gate and level of the mixed log odds."""
        n0, n1 = np.zeros(GATES * LEVELS), np.zeros(GATES * LEVELS)
        for b in batches:
            for keys, began, counts in _rows(b):
                for lo in range(0, len(keys), BLOCK):
                    g, w, n = (x[lo : lo + BLOCK] for x in (keys, began, counts))
                    for bit, slots, checks in contexts(g, w, model.bits, model.parts):
                        x, gate = model.inputs(slots, checks, bit)
                        at = gate * LEVELS + level_of(model.mix(x, gate))
                        n0 += np.bincount(at[bit == 0], n[bit == 0], GATES * LEVELS)
                        n1 += np.bincount(at[bit == 1], n[bit == 1], GATES * LEVELS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(GATES * LEVELS)), pa.array(n0), pa.array(n1)], ["at", "n0", "n1"])

    return run


def _before(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each key stood last before (-1: nowhere), and how often it stood before."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    same = np.zeros(len(k), bool)
    same[1:] = k[1:] == k[:-1]
    last = np.full(len(k), -1)
    last[order[1:]] = np.where(same[1:], order[:-1], -1)
    start = np.maximum.accumulate(np.where(same, 0, np.arange(len(k))))
    times = np.empty(len(k), np.int64)
    times[order] = np.arange(len(k)) - start
    return last, times


def own_words(words: np.ndarray, woff: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each word, from what stands before it in its text: its place, its share so far, the match predictor's weight, and whether that is right."""
    doc = tk.doc_of(woff)
    place = np.arange(len(words)) - woff[doc]
    salt = tk.mix(doc.astype(np.uint64) + np.uint64(1))
    _, times = _before(tk.mix(words ^ salt))
    share = times / np.maximum(place, 1)
    pair = np.zeros(len(words), np.uint64)
    pair[2:] = tk.mix(words[1:-1] + tk.mix(words[:-2] + salt[2:]))
    usable = place >= 2
    pair[~usable] = tk.mix(np.arange(int((~usable).sum()), dtype=np.uint64) ^ np.uint64(0x5851F42D4C957F2D))
    last, _ = _before(pair)
    tried = usable & (last >= 0)
    right = tried & (words[last] == words) if len(words) else tried
    tries, hits = (np.concatenate([[0], np.cumsum(x)]) for x in (tried, right))
    m = (hits[:-1] - hits[woff[doc]] + MATCH[0]) / (tries[:-1] - tries[woff[doc]] + MATCH[1])
    return place, share, np.where(tried, np.minimum(m, 0.98), 0), right


class Trained(NamedTuple):
    mixer: Mixer
    counts: DataFrame
    frequent: tuple[np.ndarray, np.ndarray]
    tokens: int
    types: int
    ends: int


def learn(docs: DataFrame) -> Trained:
    """The model of all the given documents."""
    texts = docs.select(F.col("text").cast("string").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    last = sizes([size // BYTES_A_GRAM])[0]
    parts = min(max(int(np.ceil(np.log2(max(size, 1) / BUCKET_BYTES))), 0), last - 8)
    packed = stored(texts.mapInArrow(_gather(parts), GATHERED).groupBy("bucket").applyInArrow(_pack(last, parts), PACKED))
    by_order = stored(packed.select("rows", "keys", "began", "counts").mapInArrow(_orders, "predictor int, key long, n long").groupBy("predictor", "key").agg(F.sum("n").alias("n")))
    known = {r.predictor: r.n for r in by_order.groupBy("predictor").agg(F.count("*").alias("n")).collect()}
    bits = (*sizes([known.get(o, 0) for o in range(ORDERS)]), last)
    model = blank(bits, parts)
    # of the contexts of a slot, the one seen most often keeps it; at most PREDICTORS * 2**MOST_BITS rows of seven bytes come back
    tallied = by_order.mapInArrow(_tally(bits, parts), "slot long, check int, n0 long, n1 long").groupBy("slot", "check").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    kept = tallied.groupBy("slot").agg(F.max(F.struct((F.col("n0") + F.col("n1")).alias("n"), "check", "n0", "n1")).alias("k")).select("slot", "k.check", "k.n0", "k.n1")
    begins, seen = sum(1 << b for b in bits[:ORDERS]), lambda pairs: COUNT[pairs >> 8] + COUNT[pairs & 255]
    for b in packed.select("slots", "checks", "zeros", "ones").toLocalIterator():
        slot = begins + np.frombuffer(b.slots, np.int32)
        q0, q1, model.checks[slot] = (np.frombuffer(x, np.uint8) for x in (b.zeros, b.ones, b.checks))
        model.pairs[slot] = q0.astype(np.uint16) << 8 | q1
    table = kept.mapInArrow(_shorten, "slot int, check byte, q0 byte, q1 byte").toArrow()
    slot, q0, q1, check = (table[c].to_numpy() for c in ("slot", "q0", "q1", "check"))
    pairs = q0.view(np.uint8).astype(np.uint16) << 8 | q1.view(np.uint8)
    more = seen(pairs) >= seen(model.pairs[slot])
    model.pairs[slot[more]], model.checks[slot[more]] = pairs[more], check[more].view(np.uint8)
    del table, slot, q0, q1, check, pairs, more
    sc = docs.sparkSession.sparkContext
    bytes_, shared = packed.select("bucket", "rows", "keys", "began", "counts"), sc.broadcast(model)
    trained = bytes_.mapInArrow(lambda it: _train(shared.value)(it), "bucket int, w binary, n double").collect()  # one row of some kB a bucket
    shared.unpersist()
    if trained:
        total = sum(r.n for r in trained)
        weights = sum(np.frombuffer(r.w).reshape(GATES, PREDICTORS + 1) * (r.n / total) for r in sorted(trained, key=lambda r: r.bucket))
        model = model._replace(weights=weights.astype(np.float32))
        again = sc.broadcast(model)
        levels = bytes_.mapInArrow(lambda it: _calibrate(again.value)(it), "at long, n0 double, n1 double").groupBy("at").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).collect()
        again.unpersist()
        refine = model.refine.copy().reshape(-1)
        for r in levels:
            refine[r.at] = (r.n1 + 20 * refine[r.at]) / (r.n0 + r.n1 + 20)
        model = model._replace(refine=refine.reshape(GATES, LEVELS))
    words = packed.select("types", "words", "word_counts").mapInArrow(_words, "word long, c long")
    sums = words.agg(F.sum("c").alias("words"), F.count("*").alias("types")).first()
    top_words = words.orderBy(F.col("c").desc(), "word").limit(FREQUENT).toArrow()
    keys = top_words["word"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    ends = packed.agg(F.sum("ends")).first()[0] or 0
    return Trained(model, words, (keys[order], top_words["c"].to_numpy()[order]), (sums.words or 0) + ends, sums.types + (ends > 0), ends)


ROWS = "rid long, doc_id long, held_out boolean, kind int, word long, n long, known long, n_bytes long, base double, score double"


def experts(words: np.ndarray, woff: np.ndarray, coded: np.ndarray, n: int) -> np.ndarray:
    """log10 probability of each document's tokens, its end the last of them, by the Bayesian mixture of experts over the mixer's probabilities coded of them.

    An expert's probabilities of what may come next, words and the end, add up to one where the mixer's do.
    """
    doc = tk.doc_of(woff)
    place, share, m, right = own_words(words, woff)
    sums = []
    for own in OWN:
        weight = own * place / (place + OWN_HALF)
        p = (1 - weight) * coded + weight * share
        for q in (p, m * right + (1 - m) * p):
            sums.append(np.bincount(doc, np.log10(np.maximum(q, 1e-300)), n))
    top_ = np.max(sums, axis=0)
    return top_ + np.log10(np.mean(10.0 ** (np.array(sums) - top_), axis=0))


def text_scores(mixer: Mixer, stream: np.ndarray, doff: np.ndarray, words: np.ndarray, woff: np.ndarray, memo: Memo | None = None) -> np.ndarray:
    """log10 probability of each document, its end included."""
    g, w = grams(stream, doff), beginnings(stream, doff)
    first, inverse = distinct(code_of(g, w))
    cost = (memo or Memo()).of(mixer, g[first], w[first])[inverse]
    stops = np.flatnonzero((stream == GAP) | (stream == END))  # the last byte of each token
    begin = np.concatenate([[0], stops + 1])[: len(stops)]
    coded = 10 ** np.maximum(np.add.reduceat(cost, begin) if len(begin) else np.zeros(0), -300.0)  # each token by itself, whatever stands beside it
    n = len(doff) - 1
    tokens = np.full(len(words) + n, END_TOKEN, np.uint64)
    tokens[np.arange(len(words)) + tk.doc_of(woff)] = words
    return experts(tokens, woff + np.arange(n + 1), coded, n)


def _score(trained: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document (kind 0) with what needs no join, and one for each of its less frequent words (kind 1)."""
    mixer, (keys, counts), ends = trained
    memo = Memo()
    names = [x.split()[0] for x in ROWS.split(", ")]
    value = np.log10(counts + 0.1)
    for b in batches:
        rids = b["rid"].to_numpy()
        for i, j, buf, off in tk.chunks(b["text"], CHUNK):
            stream, doff, words, woff = streams(buf, off)
            doc, n = tk.doc_of(woff), j - i
            at = np.minimum(np.searchsorted(keys, words), max(len(keys) - 1, 0))
            top = keys[at] == words if len(keys) else np.zeros(len(words), bool)
            base = np.bincount(doc[top], value[at[top]], n) + np.log10(ends + 0.1)
            known = np.bincount(doc[top], minlength=n) + (ends > 0)
            scores = text_scores(mixer, stream, doff, words, woff, memo)
            yield pa.RecordBatch.from_arrays([b["rid"].slice(i, n), b["doc_id"].slice(i, n), b["held_out"].slice(i, n), pa.array(np.zeros(n, np.int32)), pa.array(rids[i:j]), pa.array(np.diff(woff) + 1), pa.array(known), pa.array(np.diff(doff)), pa.array(base), pa.array(scores)], names)
            r = np.flatnonzero(~top)
            if len(r):
                # a document's equal words go as one
                _, first, times = np.unique(tk.mix(words[r]) ^ doc[r].astype(np.uint64), return_index=True, return_counts=True)
                k, r = len(first), r[first]
                yield pa.RecordBatch.from_arrays([pa.array(rids[i + doc[r]]), pa.nulls(k, pa.int64()), pa.nulls(k, pa.bool_()), pa.array(np.ones(k, np.int32)), pa.array(tk.signed(words[r])), pa.array(times), *(pa.nulls(k, t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64()))], names)


def score(docs: DataFrame, trained: Trained, folds: int = 10) -> DataFrame:
    """One row for each document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte."""
    shared = docs.sparkSession.sparkContext.broadcast((trained.mixer, trained.frequent, trained.ends))
    texts = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), (fold(folds=folds) == 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    rows = texts.mapInArrow(lambda it: _score(shared.value, it), ROWS)
    counted = rows.join(trained.counts.select(F.lit(1).alias("kind"), "word", "c"), ["kind", "word"], "left")
    other = F.col("kind") == 1
    parts = counted.select(
        "rid", "doc_id", "held_out", "n_bytes", "score",
        F.when(other, 0).otherwise(F.col("n")).alias("n"),
        F.when(other, F.when(F.col("c") > 0, F.col("n")).otherwise(0)).otherwise(F.col("known")).alias("known"),
        F.when(other, F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.1)).otherwise(F.col("base")).alias("base"),
    )
    per = parts.groupBy("rid").agg(*[F.max(c).alias(c) for c in ("doc_id", "held_out", "n_bytes", "score")], F.sum("n").alias("n_tokens"), F.sum("known").alias("n_known"), F.sum("base").alias("sum"))
    norm = F.log10(F.lit(trained.tokens + 0.1 * (trained.types + 1)))
    return per.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(trained.tokens).cast("long").alias("train_tokens"), (F.col("sum") - F.col("n_tokens") * norm).alias("base_score"),
        "score", "n_bytes", (-F.col("score") / F.log10(F.lit(2.0)) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def mixer_alone(docs: DataFrame, trained: Trained) -> DataFrame:
    """One row, to tell what the bit mixer is worth by itself, without the texts' own words: n_bytes, bits_per_byte."""
    shared = docs.sparkSession.sparkContext.broadcast(trained.mixer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer = shared.value
        for b in batches:
            for _, _, buf, off in tk.chunks(b["text"], CHUNK):
                stream, doff, _, _ = streams(buf, off)
                g, w = grams(stream, doff), beginnings(stream, doff)
                first, inverse = distinct(code_of(g, w))
                yield pa.RecordBatch.from_arrays([pa.array([len(stream)]), pa.array([float(mixer.log10(g[first], w[first])[inverse].sum())])], ["n_bytes", "cost"])

    sums = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "n_bytes long, cost double").agg(F.sum("n_bytes").alias("n_bytes"), F.sum("cost").alias("cost"))
    return sums.select("n_bytes", (-F.col("cost") / F.log10(F.lit(2.0)) / F.col("n_bytes")).alias("bits_per_byte"))
