"""FLAC media columns: any bytes as 8-bit mono PCM, encoded and decoded with numpy.

`encode` writes a complete FLAC stream for each payload: the STREAMINFO block
with its MD5, a SEEKTABLE with one point for each `SEEK_EVERY` samples, and one
frame for each block of `BLOCK` samples.  A subframe is constant, verbatim, or
a fixed linear predictor of order 0 to 4 with one partition of Rice-coded
residuals, whichever is shortest.  Every frame has its CRC-8 and CRC-16.

`decode` reads streams back: it walks the metadata, verifies both checksums of
each frame, decodes the Rice residuals and undoes the predictors, and compares
the MD5.  Streams of the kind that `encode` writes take a fast way, all frames of
a batch side by side through numpy: step i handles sample i of every frame, so
the work is a fixed number of array operations for each batch however many
frames it has.  Every other mono stream of 4 to 16 bits a sample (other block
sizes, linear predictors up to order 32, partitioned residuals with escape
codes, wasted bits), and those in which a frame's header can't be told from the
data, are read by `sequential`, frame after frame, bit by bit.

`read_samples` uses the seek table to decode only the frames that hold a range
of samples; `pcm_blocks` gives the decoded samples as a table of blocks with
their first sample and the offset of their frame in the stream, by which a block
can be found again without the others.

Nulls and edges: null texts count as empty, and an empty payload still has one
padded block (see `pad`).  Long payloads only have more frames.  Rows are handled
one by one, so repeated rows, shared or null identifiers and ties make no
difference: equal texts give equal values.  Columns besides doc_id and text are
not read, whatever their names.  An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch

BLOCK = 192
SEEK_EVERY = 16 * BLOCK
RATE = 8000
MAX_K = 14
#: bytes of text that go through numpy at once
BATCH_BYTES = 1_500_000
MEDIA = "doc_id long, n_bytes long, payload_bytes long, media binary"
FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _crc_table(poly: int, bits: int) -> np.ndarray:
    top, mask = 1 << (bits - 1), (1 << bits) - 1
    out = np.zeros(256, np.uint16)
    for i in range(256):
        c = i << (bits - 8)
        for _ in range(8):
            c = ((c << 1) ^ poly if c & top else c << 1) & mask
        out[i] = c
    return out


_CRC8, _CRC16 = _crc_table(0x07, 8).astype(np.uint8), _crc_table(0x8005, 16)
#: the CRC-16 of two bytes at once
_CRC16_PAIR = _CRC16[np.arange(1 << 16) >> 8]
_CRC16_PAIR = (_CRC16_PAIR << np.uint16(8)) ^ _CRC16[(_CRC16_PAIR >> np.uint16(8)) ^ (np.arange(1 << 16) & 0xFF).astype(np.uint16)]


class BadStream(ValueError):
    """The bytes are no FLAC stream of this kind, or a checksum doesn't match."""


def pad(data: bytes) -> bytes:
    """The data with spaces appended up to a positive multiple of BLOCK."""
    return data + b" " * (-len(data) % BLOCK or (0 if data else BLOCK))


def crc8(rows: np.ndarray, length: np.ndarray) -> np.ndarray:
    out = np.zeros(len(rows), np.uint8)
    for i in range(int(length.max(initial=0))):
        out = np.where(i < length, _CRC8[out ^ rows[:, i]], out)
    return out


def crc16(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-16 of each frame of the data.

    Zero bytes in front don't change a CRC that begins with zero, so the frames are aligned at their ends and take two bytes a step.
    """
    width = int(length.max(initial=0) + 1) // 2 * 2
    view = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.zeros(width, np.uint8), data]), width)
    rows = view[start + length]
    rows[np.arange(width) < (width - length)[:, None]] = 0
    pairs = np.ascontiguousarray(rows.view(">u2").T).astype(np.uint16)
    out = np.zeros(len(start), np.uint16)
    for p in pairs:
        out = _CRC16_PAIR[out ^ p]
    return out


def frame_number(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers in the format's variable-length code: bytes (rows of 6) and their count."""
    out = np.zeros((len(n), 6), np.uint8)
    size = np.select([n < 0x80, n < 0x800, n < 0x10000, n < 0x200000, n < 0x4000000], [1, 2, 3, 4, 5], 6)
    for k in range(1, 7):
        m = size == k
        v = n[m]
        if k == 1:
            out[m, 0] = v
            continue
        out[m, 0] = ((0xFF00 >> k) & 0xFF) | (v >> (6 * (k - 1)))
        for j in range(1, k):
            out[m, j] = 0x80 | ((v >> (6 * (k - 1 - j))) & 0x3F)
    return out, size


def _headers(number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame headers with their CRC-8: sync code, fixed block size 192 (code 1), rate 8 kHz (code 4), mono, 8 bits a sample (code 1)."""
    code, size = frame_number(number)
    rows = np.zeros((len(number), 11), np.uint8)
    rows[:, :4] = (0xFF, 0xF8, 0x14, 0x02)
    rows[:, 4:10] = code
    rows[np.arange(len(number)), 4 + size] = crc8(rows, 4 + size)
    return rows, 5 + size


def _frames(x: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Encoded frames of the rows of x (int16 samples): all their bytes one after the other, and the length of each.

    The predictor is the one whose residuals have the least sum of magnitudes, as is usual for this format.
    """
    n = len(x)
    order = np.zeros(n, np.int64)
    least = np.abs(x).sum(1, dtype=np.int32)
    r = x
    residuals = [x]
    for o in range(1, 5):
        r = np.diff(r, axis=1)
        residuals.append(r)
        total = np.abs(r).sum(1, dtype=np.int32)
        order = np.where(total < least, o, order)
        least = np.minimum(total, least)
    head, hsize = _headers(number)
    same = (x == x[:, :1]).all(1)
    codes, size = {}, np.where(same, 2, 1 + BLOCK)
    for o in range(5):
        m = np.flatnonzero((order == o) & ~same)
        if not len(m):
            continue
        r = residuals[o][m]
        z = ((r << 1) ^ (r >> 15)).astype(np.int32)
        mean = z.sum(1) / (BLOCK - o)
        k = np.clip(np.floor(np.log2(np.maximum(mean * 0.75, 1))), 0, MAX_K).astype(np.int32)
        q = z >> k[:, None]
        bits = q.sum(1) + (BLOCK - o) * (1 + k) + 18 + 8 * o
        good = bits <= 8 * BLOCK
        codes[o] = (m[good], z[good], k[good], q[good])
        size[m[good]] = (bits[good] + 7) // 8
    body = size
    size = hsize + body + 2
    start = np.cumsum(size) - size
    out = np.zeros(int(size.sum()) + 8, np.uint8)
    at = start + hsize
    u8 = x.astype(np.int8).view(np.uint8)
    out[at[same] + 1] = u8[same, 0]
    m = np.flatnonzero(body == 1 + BLOCK)
    out[at[m]] = 0x02
    out[at[m][:, None] + 1 + np.arange(BLOCK)] = u8[m]
    places, values = [], []
    for o, (m, z, k, q) in codes.items():
        out[at[m]] = 0x10 | o << 1
        out[at[m][:, None] + 1 + np.arange(o)] = u8[m, :o]
        base = at[m] + 1 + o
        # coding method 0, partition order 0, the 4-bit parameter: 10 bits
        out[base], out[base + 1] = k >> 2, (k & 3) << 6
        # each code's stop bit and remainder, at the end of its quotient's zeros
        length = k[:, None] + 1
        stop = (base * 8 + 10)[:, None] + np.cumsum(q + length, axis=1, dtype=np.int64) - length
        value = (1 << k[:, None]) | (z & ((1 << k[:, None]) - 1))
        places.append((stop >> 3).ravel())
        values.append((value << (24 - length - (stop & 7).astype(np.int32))).ravel())
    if places:
        place, value = np.concatenate(places), np.concatenate(values)
        # codes that meet in a byte have different bits of it, so that a sum joins them
        for j in range(3):
            out += np.bincount(place + j, (value >> (16 - 8 * j)) & 0xFF, len(out)).astype(np.uint8)
    out = out[: int(size.sum())]
    for j in range(11):
        m = j < hsize
        out[start[m] + j] = head[m, j]
    crc = crc16(out, start, size - 2)
    out[start + size - 2], out[start + size - 1] = crc >> 8, crc & 0xFF
    return out, size


def _columns(data: np.ndarray, start: np.ndarray, width: int) -> np.ndarray:
    """Byte i of every frame in row i; zeros past the data's end."""
    padded = np.concatenate([data, np.zeros(width, np.uint8)])
    view = np.lib.stride_tricks.sliding_window_view(padded, width)
    return np.ascontiguousarray(view[start].T)


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each payload; their lengths are positive multiples of BLOCK."""
    if not payloads:
        return []
    if any(not p or len(p) % BLOCK for p in payloads):
        raise ValueError(f"payloads must have a positive multiple of {BLOCK} bytes")
    counts = np.array([len(p) // BLOCK for p in payloads])
    x = (np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, BLOCK).astype(np.int16)) - 128
    first = np.cumsum(counts) - counts
    number = np.arange(len(x)) - np.repeat(first, counts)
    data, size = _frames(x, number)
    ends = np.cumsum(size)
    out = []
    for i, p in enumerate(payloads):
        lo, hi = int(first[i]), int(first[i] + counts[i])
        begin = int(ends[lo] - size[lo])
        pcm = (x[lo:hi].astype(np.int8)).tobytes()
        sizes = size[lo:hi]
        info = struct.pack(">HH", BLOCK, BLOCK) + int(sizes.min()).to_bytes(3, "big") + int(sizes.max()).to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | len(p)).to_bytes(8, "big") + hashlib.md5(pcm).digest()
        every = SEEK_EVERY // BLOCK
        points = b"".join(struct.pack(">QQH", j * BLOCK, int(ends[lo + j] - size[lo + j]) - begin, BLOCK) for j in range(0, hi - lo, every))
        out.append(b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(points).to_bytes(3, "big") + points + data[begin : int(ends[hi - 1])].tobytes())
    return out


def metadata(stream: bytes) -> tuple[dict, int]:
    """What STREAMINFO and SEEKTABLE say, and where the frames begin."""
    if stream[:4] != b"fLaC":
        raise BadStream("no FLAC marker")
    at, out, last = 4, {"points": []}, False
    while not last:
        if at + 4 > len(stream):
            raise BadStream("the metadata are cut short")
        last, kind, size = bool(stream[at] & 0x80), stream[at] & 0x7F, int.from_bytes(stream[at + 1 : at + 4], "big")
        body = stream[at + 4 : at + 4 + size]
        if kind == 0 and size >= 34 and len(body) == size:
            packed = int.from_bytes(body[10:18], "big")
            out |= {"block": struct.unpack(">H", body[:2])[0], "min_frame": int.from_bytes(body[4:7], "big"), "max_frame": int.from_bytes(body[7:10], "big"), "bits": (packed >> 36 & 31) + 1, "channels": (packed >> 41 & 7) + 1, "samples": packed & (1 << 36) - 1, "md5": body[18:34]}
        elif kind == 3:
            out["points"] = [struct.unpack(">QQH", body[i : i + 18]) for i in range(0, len(body) - 17, 18)]
        at += 4 + size
    if "block" not in out or out["channels"] != 1 or not 4 <= out["bits"] <= 16:
        raise BadStream("only mono streams of 4 to 16 bits a sample are read")
    return out, at


def _decode_frames(data: np.ndarray, start: np.ndarray, number: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Samples of the frames that start at start and end at stop; checksums verified."""
    n = len(start)
    size = stop - start
    cols = _columns(data, start, max(int(size.max()), 16))
    head, hsize = _headers(number)
    for j in range(10):
        m = j < hsize
        if (cols[j][m] != head[m, j]).any():
            raise BadStream("a frame header or its CRC-8 is wrong")
    if (size < hsize + 4).any() or (crc16(data, start, size - 2) != data[stop - 2].astype(np.uint16) << np.uint16(8) | data[stop - 1]).any():
        raise BadStream("a frame's CRC-16 is wrong")
    lane = np.arange(n)
    kind = cols[hsize, lane]
    x = np.zeros((BLOCK, n), np.int32)
    end = hsize + 1
    m = kind == 0x00
    if m.any():
        x[:, m] = cols[hsize[m] + 1, lane[m]].view(np.int8)
        end = np.where(m, hsize + 2, end)
    m = kind == 0x02
    if m.any():
        x[:, m] = cols[hsize[m][None] + 1 + np.arange(BLOCK)[:, None], lane[m][None]].view(np.int8)
        end = np.where(m, hsize + 1 + BLOCK, end)
    fixed = (kind & 0xF1 == 0x10) & (kind <= 0x18)
    if not (fixed | (kind == 0) | (kind == 2)).all():
        raise BadStream("a subframe of an unknown kind")
    f = np.flatnonzero(fixed)
    if len(f):
        order = (kind[f] >> 1 & 7).astype(np.int64)
        base = hsize[f] + 1
        warm = np.zeros((4, len(f)), np.int32)
        for j in range(4):
            m = order > j
            warm[j, m] = cols[base[m] + j, f[m]].view(np.int8)
        z, used = _rice(data, start[f] + base + order, order)
        end[f] = base + order + (used + 7) // 8
        e = (z >> 1) ^ -(z & 1)
        for o in range(5):
            m = np.flatnonzero(order == o)
            if len(m):
                y, w = e[:, m], warm[:, m]
                for d in range(o - 1, -1, -1):  # the d-th differences from those one higher
                    y[d] = np.diff(w[: d + 1], d, axis=0)[0] if d else w[0]
                    np.cumsum(y[d:], axis=0, out=y[d:])
                x[:, f[m]] = y
    if (end + 2 != size).any():
        raise BadStream("a frame doesn't end where the next one starts")
    return x.T


def _rice(data: np.ndarray, at: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rice codes of every frame: values by sample and frame (none before the predictor's order), and the bits used from byte at on."""
    data = np.concatenate([data, np.zeros(16, np.uint8)])
    words = np.zeros(len(data) - 7, np.uint64)
    for j in range(8):
        words = words << np.uint64(8) | data[j : j + len(words)]
    three, seven, one = np.uint64(3), np.uint64(7), np.uint64(1)
    pos = at.astype(np.uint64) << three
    first = pos
    top = words[at]
    if (top >> np.uint64(58)).any():
        raise BadStream("only one partition of Rice codes is read")
    k = top >> np.uint64(54) & np.uint64(15)
    drop, step = np.uint64(64) - k, k + one
    pos = pos + np.uint64(10)
    last = np.uint64(len(words) * 8 - 1)
    out = np.zeros((BLOCK, len(at)), np.uint32)
    for i in range(BLOCK):
        w = words[pos >> three] << (pos & seven)
        # the leading zeros, from the exponent of the upper 52 bits as a float
        q = np.uint64(1074) - ((w >> np.uint64(12)).astype(np.float64).view(np.uint64) >> np.uint64(52))
        after = pos + q + one
        far = q + k > 54
        r = (w << (q + one)) >> drop
        if far.any():  # a code longer than one look
            for j in np.flatnonzero(far & (order <= i)):
                p = int(pos[j])
                while not data[p >> 3] >> (7 - (p & 7)) & 1:
                    p += 1
                    if p >= len(data) * 8:
                        raise BadStream("a Rice code has no end")
                q[j], after[j] = p - int(pos[j]), p + 1
                r[j] = (words[(p + 1) >> 3] << np.uint64((p + 1) & 7)) >> drop[j]
        if i < 4:
            live = order <= i
            out[i, live] = (q << k | r)[live]
            pos = np.where(live, after + k, pos)
        else:
            out[i] = q << k | r
            pos = np.minimum(after + k, last)
    return out.astype(np.int32), (pos - first).astype(np.int64)


def _starts(streams: list[tuple[bytes, dict, int]], origin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, number and end of every frame of the streams, found by the header that each frame must have.

    A chance look-alike inside a frame would have to carry sync code, frame number and CRC-8; the CRC-16 tells it in the end.
    """
    starts, ends = [], []
    counts = [-(-info["samples"] // BLOCK) for _, info, _ in streams]
    want, size = _headers(np.arange(max(counts)))
    want = [w[:s].tobytes() for w, s in zip(want, size.tolist(), strict=True)]
    every = SEEK_EVERY // BLOCK
    for (stream, info, at), o, n in zip(streams, origin.tolist(), counts, strict=True):
        low, points = max(info["min_frame"], 1), info["points"]
        p = at
        for i in range(n):
            if i % every == 0 and i // every < len(points):
                p = at + points[i // every][1]
            elif i:
                p = stream.find(want[i], p + low)
            if p < 0:
                raise BadStream("a frame is missing")
            starts.append(o + p)
        ends += starts[len(ends) + 1 :] + [o + len(stream)]
    return np.array(starts, np.int64), np.concatenate([np.arange(n) for n in counts]), np.array(ends, np.int64)


class _Bits:
    """A stream's bits from a byte on."""

    def __init__(self, data: bytes, at: int):
        self.data, self.pos = data, at * 8

    def take(self, n: int) -> int:
        if self.pos + n > len(self.data) * 8:
            raise BadStream("the stream is cut short")
        lo, hi = self.pos >> 3, (self.pos + n + 7) >> 3
        self.pos += n
        return int.from_bytes(self.data[lo:hi], "big") >> (hi * 8 - self.pos) & ((1 << n) - 1)

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v - (1 << n) if n and v >> (n - 1) else v

    def zeros(self) -> int:
        n = 0
        while not self.take(1):
            n += 1
        return n


def _checksum(data: bytes, table: np.ndarray, bits: int) -> int:
    out = 0
    for x in data:
        out = (out << 8 & (1 << bits) - 1) ^ int(table[out >> (bits - 8) ^ x])
    return out


def _residuals(bits: _Bits, size: int, order: int) -> list[int]:
    """Partitioned Rice codes; a partition with the escape parameter holds plain numbers."""
    method = bits.take(2)
    if method > 1:
        raise BadStream("residuals of an unknown coding")
    wide, parts, out = (4, 5)[method], bits.take(4), []
    if size % (1 << parts) or size >> parts < order:
        raise BadStream("partitions that don't fit the block")
    for i in range(1 << parts):
        n, k = (size >> parts) - (order if i == 0 else 0), bits.take(wide)
        if k == (1 << wide) - 1:
            width = bits.take(5)
            out += [bits.signed(width) for _ in range(n)]
        else:
            for _ in range(n):
                z = bits.zeros() << k | bits.take(k)
                out.append(z >> 1 ^ -(z & 1))
    return out


#: coefficients of the fixed predictors, nearest sample first
_FIXED = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]]


def _subframe(bits: _Bits, size: int, depth: int) -> list[int]:
    if bits.take(1):
        raise BadStream("a subframe doesn't begin with a zero")
    kind, wasted = bits.take(6), 0
    if bits.take(1):
        wasted = bits.zeros() + 1
    depth -= wasted
    if kind == 0:
        out = [bits.signed(depth)] * size
    elif kind == 1:
        out = [bits.signed(depth) for _ in range(size)]
    elif 8 <= kind <= 12 or kind >= 32:
        order = kind - 8 if kind < 32 else kind - 31
        out, shift, weights = [bits.signed(depth) for _ in range(order)], 0, _FIXED[order] if kind < 32 else []
        if kind >= 32:
            precision, shift = bits.take(4) + 1, bits.signed(5)
            if precision == 16 or shift < 0:
                raise BadStream("a linear predictor of an unknown kind")
            weights = [bits.signed(precision) for _ in range(order)]
        for e in _residuals(bits, size, order):
            out.append(e + (sum(w * out[-1 - i] for i, w in enumerate(weights)) >> shift))
    else:
        raise BadStream("a subframe of an unknown kind")
    return [x << wasted for x in out]


def frames_of(stream: bytes, at: int, depth: int) -> Iterator[tuple[int, list[int]]]:
    """(offset, samples) of each frame from byte at on; where a frame ends follows from its bits."""
    while at < len(stream):
        bits = _Bits(stream, at)
        if bits.take(15) != 0x7FFC:
            raise BadStream("a frame doesn't begin with the sync code")
        bits.take(1)
        block, rate, channels, width = bits.take(4), bits.take(4), bits.take(4), bits.take(3)
        bits.take(1)
        first = bits.take(8)
        more = 0 if first < 0x80 else 8 - (first ^ 0xFF).bit_length()
        if more == 1 or more > 7 or any(bits.take(8) >> 6 != 2 for _ in range(max(more - 1, 0))):
            raise BadStream("a frame's number is wrong")
        size = {1: 192, 6: 0, 7: 0}.get(block, 576 << block - 2 if 2 <= block <= 5 else 1 << block if block >= 8 else -1)
        size = bits.take(8 if block == 6 else 16) + 1 if block in (6, 7) else size
        bits.take({12: 8, 13: 16, 14: 16}.get(rate, 0))
        if size < 0 or channels or width not in (0, {8: 1, 12: 2, 16: 4}.get(depth, 0)):
            raise BadStream("a frame of an unknown size, or that isn't mono")
        if bits.take(8) != _checksum(stream[at : (bits.pos >> 3) - 1], _CRC8, 8):
            raise BadStream("a frame header or its CRC-8 is wrong")
        samples = _subframe(bits, size, depth)
        bits.pos = -(-bits.pos // 8) * 8
        end = bits.pos >> 3
        if bits.take(16) != _checksum(stream[at:end], _CRC16, 16):
            raise BadStream("a frame's CRC-16 is wrong")
        yield at, samples
        at = end + 2


def sequential(stream: bytes) -> list[int]:
    """The samples of any mono stream, every checksum verified, frame after frame."""
    info, at = metadata(stream)
    out = [x for _, samples in frames_of(stream, at, info["bits"]) for x in samples]
    if info["samples"] and len(out) != info["samples"]:
        raise BadStream("the stream hasn't the number of samples that it says")
    width = -(-info["bits"] // 8)
    if any(info["md5"]) and hashlib.md5(b"".join(x.to_bytes(width, "little", signed=True) for x in out)).digest() != info["md5"]:
        raise BadStream("the MD5 of the samples is wrong")
    return out


def _fast(info: dict) -> bool:
    return info["block"] == BLOCK and info["bits"] == 8 and info["samples"] > 0


def decode(streams: list[bytes]) -> list[bytes]:
    """The payload of each 8-bit stream, every checksum verified."""
    fast = [i for i, s in enumerate(streams) if _fast(metadata(s)[0])]
    out: list[bytes | None] = [None] * len(streams)
    try:
        for i, x in zip(fast, _decode_alike([streams[i] for i in fast]), strict=True):
            out[i] = x
    except (BadStream, IndexError):
        pass  # one of them is of another kind or damaged: each is read by itself, and damage shows there
    for i, s in enumerate(streams):
        if out[i] is None:
            if metadata(s)[0]["bits"] != 8:
                raise BadStream("only samples of eight bits are payloads")
            out[i] = bytes(x + 128 for x in sequential(s))
    return out


def _decode_alike(streams: list[bytes]) -> list[bytes]:
    """`decode` for streams as `encode` writes them."""
    if not streams:
        return []
    parsed = []
    for s in streams:
        info, first = metadata(s)
        parsed.append((s, info | {"first": first}, first))
    origin = np.cumsum([0, *map(len, streams)])[:-1]
    data = np.frombuffer(b"".join(streams), np.uint8)
    x = _decode_frames(data, *_starts(parsed, origin))
    raw = x.astype(np.int8).tobytes()
    pcm = (x + 128).astype(np.uint8).tobytes()
    out, at = [], 0
    for _, info, _ in parsed:
        size = -(-info["samples"] // BLOCK) * BLOCK
        if hashlib.md5(raw[at : at + size]).digest() != info["md5"]:
            raise BadStream("the MD5 of the samples is wrong")
        out.append(pcm[at : at + info["samples"]])
        at += size
    return out


def read_samples(stream: bytes, first: int, count: int) -> bytes:
    """Samples first..first+count of a stream; only frames from the seek point before on are looked at."""
    info, begin = metadata(stream)
    count = max(0, min(count, info["samples"] - first))
    if not count:
        return b""
    want, size = _headers(np.arange(-(-info["samples"] // BLOCK)))
    sample, offset, _ = max(p for p in info["points"] if p[0] <= first)
    at, lo, hi = begin + offset, sample // BLOCK, -(-(first + count) // BLOCK)
    starts = [at]
    for i in range(lo + 1, hi):
        starts.append(stream.find(want[i, : size[i]].tobytes(), starts[-1] + max(info["min_frame"], 1)))
    after = stream.find(want[hi, : size[hi]].tobytes(), starts[-1] + 1) if hi < len(want) else len(stream)
    x = _decode_frames(np.frombuffer(stream, np.uint8), np.array(starts), np.arange(lo, hi), np.array([*starts[1:], after]))
    return (x + 128).astype(np.uint8).tobytes()[first - sample : first - sample + count]


def features(payload: bytes) -> str:
    """Mean, deviation, sign changes around the mean and peak-to-peak of the samples, as text."""
    x = np.frombuffer(payload, np.uint8).astype(np.int16)
    total, squares = int(x.sum(dtype=np.int64)), int((x.astype(np.int64) ** 2).sum())
    mean = total / len(x)
    above = x > mean
    return f"mean={mean:.4f};std={max(squares / len(x) - mean * mean, 0) ** 0.5:.4f};crossings={int((above[1:] != above[:-1]).sum())};range={int(x.max() - x.min())}"


def _groups(sizes: list[int]) -> Iterator[tuple[int, int]]:
    lo = 0
    while lo < len(sizes):
        hi, total = lo + 1, sizes[lo]
        while hi < len(sizes) and total + sizes[hi] <= BATCH_BYTES:
            total += sizes[hi]
            hi += 1
        yield lo, hi
        lo = hi


def to_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, media): the padded UTF-8 text of every row as a FLAC stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [x or b"" for x in b["text"].to_pylist()]
            for lo, hi in _groups([len(x) for x in raw]):
                payloads = [pad(x) for x in raw[lo:hi]]
                yield pa.RecordBatch.from_arrays([b["doc_id"][lo:hi], pa.array([len(x) for x in raw[lo:hi]], pa.int64()), pa.array([len(x) for x in payloads], pa.int64()), pa.array(encode(payloads), pa.binary())], ["doc_id", "n_bytes", "payload_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(F.col("text").cast("string"), "utf-8").alias("text")).mapInArrow(run, MEDIA)


def read_media(media: DataFrame) -> DataFrame:
    """What decoding each row of `to_media` shows: digests of the payload and of the stored form, and features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            streams = b["media"].to_pylist()
            for lo, hi in _groups([len(x) for x in streams]):
                back = decode(streams[lo:hi])
                yield pa.RecordBatch.from_arrays(
                    [
                        b["doc_id"][lo:hi],
                        b["n_bytes"][lo:hi],
                        pa.array([len(x) for x in back], pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in back]),
                        pa.array([zlib.crc32(x[-16:]) for x in back], pa.int64()),
                        pa.array([len(x) for x in streams[lo:hi]], pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in streams[lo:hi]]),
                        pa.array([features(x) for x in back]),
                    ],
                    [x.split()[0] for x in FEATURES.split(", ")],
                )

    return media.mapInArrow(run, FEATURES)


BLOCKS = "doc_id long, block long, first_sample long, samples int, frame_offset long, pcm binary"


def pcm_blocks(media: DataFrame) -> DataFrame:
    """BLOCKS of each row of `to_media`: the decoded samples frame by frame, each with its first sample and where its frame stands in the stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in BLOCKS.split(", ")]
        for b in batches:
            for doc_id, stream in zip(b["doc_id"].to_pylist(), b["media"].to_pylist(), strict=True):
                info, at = metadata(stream)
                rows, first = [], 0
                for i, (offset, x) in enumerate(frames_of(stream, at, info["bits"])):
                    rows.append((doc_id, i, first, len(x), offset, np.array(x, "<i1" if info["bits"] <= 8 else "<i2").tobytes()))
                    first += len(x)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names)

    return media.select("doc_id", "media").mapInArrow(run, BLOCKS)


def block_at(stream: bytes, frame_offset: int) -> bytes:
    """The PCM of the frame at an offset of `pcm_blocks`, read without the frames before it."""
    bits = metadata(stream)[0]["bits"]
    return np.array(next(frames_of(stream, frame_offset, bits))[1], "<i1" if bits <= 8 else "<i2").tobytes()


def store(media: DataFrame) -> DataFrame:
    """The media column written to the shared folder and read from it."""
    path = scratch(media.sparkSession, "media")
    media.write.option("compression", "zstd").parquet(path)
    return media.sparkSession.read.parquet(path)
