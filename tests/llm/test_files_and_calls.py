"""FLAC, WARC and tool calls: round trips and damage."""

import base64
import gzip
import hashlib
import json
import random
import zlib

import pytest

from pagequarry.llm import flac, toolcalls, warc

PAYLOADS = [b"\x00" * 192, bytes(range(192)), random.Random(1).randbytes(192 * 300), b"\xff\x00" * 288, b"the cat sat on the mat " * 200 + b" " * 152]


@pytest.mark.parametrize("i", range(len(PAYLOADS)))
def test_flac_round_trip(i):
    p = PAYLOADS[i][: len(PAYLOADS[i]) // 192 * 192]
    (s,) = flac.encode([p])
    assert flac.decode([s]) == [p] and s[:4] == b"fLaC"
    assert flac.read_samples(s, 100, 700) == p[100:800] and flac.read_samples(s, len(p), 5) == b""


def test_flac_batch_and_long_codes():
    ps = [flac.pad(random.Random(i).randbytes(i * 7 % 900)) for i in range(60)]
    spikes = bytearray(b"\x80" * 192 * 4)
    spikes[50], spikes[300], spikes[301] = 255, 0, 255
    ps.append(bytes(spikes))
    assert flac.decode(flac.encode(ps)) == ps and flac.encode([]) == [] and flac.decode([]) == []


class Bits:
    """Writes a FLAC stream bit by bit, for kinds that the encoder doesn't write."""

    def __init__(self):
        self.s = ""

    def put(self, v, n):
        self.s += format(v & (1 << n) - 1, f"0{n}b") if n else ""

    def rice(self, e, k):
        z = e << 1 if e >= 0 else (-e << 1) - 1
        self.s += "0" * (z >> k) + "1"
        self.put(z, k)

    def bytes(self):
        s = self.s + "0" * (-len(self.s) % 8)
        return int(s, 2).to_bytes(len(s) // 8, "big")


def crc(data, poly, bits):
    out = 0
    for b in data:
        out ^= b << bits - 8
        for _ in range(8):
            out = (out << 1 ^ poly if out >> bits - 1 else out << 1) & (1 << bits) - 1
    return out.to_bytes(bits // 8, "big")


def linear_stream(samples, size, depth, escape=False):
    """A mono stream with a second-order linear predictor, four partitions a block, and an odd block at the end."""
    body = b""
    for i in range(0, len(samples), size):
        x = samples[i : i + size]
        head = Bits()
        for v, n in ((0x7FFC, 15), (0, 1), (7, 4), (0, 4), (0, 4), ({8: 1, 16: 4}[depth], 3), (0, 1), (i // size, 8), (len(x) - 1, 16)):
            head.put(v, n)
        frame = head.bytes() + crc(head.bytes(), 0x07, 8)
        sub = Bits()
        sub.put(33 << 1, 8)  # linear, order 2
        for v in x[:2]:
            sub.put(v, depth)
        for v, n in ((6, 4), (3, 5), (14, 7), (-7, 7)):  # precision 7, shift 3, coefficients
            sub.put(v, n)
        parts = 2 if len(x) % 4 == 0 else 0
        sub.put(0, 2), sub.put(parts, 4)
        e = [0, 0] + [x[j] - (14 * x[j - 1] - 7 * x[j - 2] >> 3) for j in range(2, len(x))]
        for j in range(1 << parts):
            part = e[j * len(x) >> parts : (j + 1) * len(x) >> parts][2 * (j == 0) :]
            if escape and j == 1:
                sub.put(15, 4), sub.put(18, 5)
                for v in part:
                    sub.put(v, 18)
            else:
                sub.put(3 + j, 4)
                for v in part:
                    sub.rice(v, 3 + j)
        frame += sub.bytes()
        body += frame + crc(frame, 0x8005, 16)
    info = size.to_bytes(2, "big") * 2 + bytes(6) + (8000 << 44 | depth - 1 << 36 | len(samples)).to_bytes(8, "big")
    md5 = hashlib.md5(b"".join(v.to_bytes(depth // 8, "little", signed=True) for v in samples)).digest()
    return b"fLaC\x80\x00\x00\x22" + info + md5 + body


@pytest.mark.parametrize("depth", [8, 16])
def test_flac_reads_linear_predictors_partitions_and_escapes(depth):
    r, x = random.Random(3), [0]
    for _ in range(1000):
        x.append(max(-100, min(100, x[-1] + r.randint(-9, 9))))
    for escape in (False, True):
        s = linear_stream(x, 256, depth, escape)
        assert flac.sequential(s) == x
        if depth == 8:
            assert flac.decode([s, flac.encode([flac.pad(b"abc")])[0]]) == [bytes(v + 128 for v in x), flac.pad(b"abc")]
    with pytest.raises(flac.BadStream):
        flac.sequential(s[:-3] + bytes([s[-3] ^ 1]) + s[-2:])


def test_flac_sequential_agrees_with_the_fast_way_and_sees_through_look_alikes():
    header = bytes(flac._headers(flac.np.array([1]))[0][0][:6])
    tricky = flac.pad(random.Random(5).randbytes(100) + bytes((b + 128) % 256 for b in header) + random.Random(6).randbytes(250))
    for p in [*PAYLOADS[:4], tricky]:
        (s,) = flac.encode([p])
        assert bytes(v + 128 for v in flac.sequential(s)) == p and flac.decode([s]) == [p]


def test_flac_blocks_are_found_by_their_offsets(spark):
    texts = [(1, "some text " * 100), (2, None), (None, "x")]
    media = flac.to_media(spark.createDataFrame(texts, "doc_id long, text string"))
    streams = {r.doc_id: r.media for r in media.collect()}
    rows = flac.pcm_blocks(media).collect()
    for d, t in texts:
        mine = sorted((r for r in rows if r.doc_id == d), key=lambda r: r.block)
        p = flac.pad((t or "").encode())
        assert bytes((b + 128) % 256 for r in mine for b in r.pcm) == p and [r.first_sample for r in mine] == list(range(0, len(p), 192))
        assert all(flac.block_at(streams[d], r.frame_offset) == r.pcm for r in mine)


def test_flac_notices_damage():
    s = bytearray(flac.encode([flac.pad(b"some text " * 100)])[0])
    s[-20] ^= 4
    with pytest.raises(flac.BadStream):
        flac.decode([bytes(s)])


def test_flac_crc():
    assert flac.crc8(flac.np.frombuffer(b"123456789", flac.np.uint8).reshape(1, 9), flac.np.array([9]))[0] == 0xF4
    for n in (8, 9):
        data, want = b"123456789"[:n], 0
        for b in data:
            want ^= b << 8
            for _ in range(8):
                want = ((want << 1) ^ 0x8005 if want & 0x8000 else want << 1) & 0xFFFF
        assert flac.crc16(flac.np.frombuffer(data, flac.np.uint8), flac.np.array([0]), flac.np.array([n]))[0] == want


def test_flac_columns(spark):
    rows = [(1, None), (2, ""), (3, "é" * 500), (3, "é" * 500), (None, "x" * 192), (5, "long " * 40000)]
    got = flac.read_media(flac.to_media(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert len(got) == 6
    for r in got:
        raw = (dict(rows)[r.doc_id] or "").encode()
        p = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
    assert got[2].media_sha256 == got[3].media_sha256
    assert flac.read_media(flac.to_media(spark.createDataFrame([], "doc_id long, text string"))).isEmpty()


def test_warc(spark, tmp_path):
    rows = [(1, "http://a/\r\nX: y", "same"), (2, None, "same"), (3, "u", None), (4, "u", ""), (5, "u", "é" * 90000), (None, "u", "same"), (7, "u", "same"), (7, "u", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, payload string").repartition(3)
    got = warc.store_and_read(pages, str(tmp_path / "w"), payloads=True).collect()
    assert len(got) == 8
    for r in got:
        data = ({k: p for k, _, p in rows}[r.page_id] or "").encode()
        assert (r.payload_bytes, r.payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert (r.record_type == "response") == (r.refers_to is None) and (r.payload == data if r.record_type == "response" else r.payload is None)
    kinds = {r.page_id: (r.record_type, r.refers_to) for r in got}
    # a row without an identifier is a response, and none refers to it
    assert kinds[None] == kinds[7] == ("response", None) and kinds[1] == kinds[2] == ("revisit", 7) and kinds[4] == ("response", None) and kinds[3] == ("revisit", 4)
    assert warc.store_and_read(spark.createDataFrame([], pages.schema), str(tmp_path / "e")).isEmpty()
    assert all(r.record_type == "response" for r in warc.store_and_read(pages.filter("page_id IN (3, 4)"), str(tmp_path / "m"), min_bytes=1).collect())


def test_warc_of_other_writers():
    """No digests, other identifiers, a record of another type, folded headers in other cases."""
    info = b"WARC/1.0\r\nwarc-type: warcinfo\r\nWARC-Record-ID: <urn:uuid:1-2>\r\nCONTENT-LENGTH: 3\r\n\r\nabc\r\n\r\n"
    block = b"HTTP/1.1 200 OK\r\ncontent-type: text/html\r\n\r\nhello"
    page = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: http://a/\r\n b\r\nWARC-Payload-Digest: sha1:" + hashlib.sha1(b"hello").hexdigest().encode() + b"\r\nContent-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"
    rows = [warc.parse(r) for r in warc.records(warc.gzip_member(info) + warc.gzip_member(page))]
    assert [r[0] for r in rows] == [None, None] and rows[0][2:4] == ("warcinfo", 3) and rows[1][1:4] == ("http://a/ b", "response", 5) and rows[1][6] == b"hello"
    for bad in (page.replace(b"hello", b"hullo"), page.replace(b"Content-Length", b"X-Length"), b""):
        with pytest.raises(warc.BadArchive):
            [warc.parse(r) for r in warc.records(warc.gzip_member(bad))]
    assert b"WARC-Date: " in gzip.decompress(warc.gzip_member(warc.record_bytes(1, "u", b"x", None)))


def test_warc_beyond_the_broadcast(spark, monkeypatch):
    rows = [(i, "u", "hot" if i % 3 else f"t{i % 5}", "clash") for i in range(60)] + [(None, "u", "hot", "clash"), (None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, payload string, digest string")
    with_it = sorted(map(str, warc.link_revisits(pages).collect()))
    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", 0)
    assert sorted(map(str, warc.link_revisits(pages).collect())) == with_it
    assert all(r.refers_to is None for r in warc.link_revisits(pages).collect() if r.page_id == (1 << 63) - 1)


def test_warc_framing():
    one, two = (warc.gzip_member(warc.record_bytes(i, "u", b"\r\n\r\nx", None)) for i in (1, 2))
    assert [warc.parse(r)[0] for r in warc.records(one + two)] == [1, 2] and gzip.decompress(one).startswith(b"WARC/1.1\r\n")
    for bad in (one[:-9], warc.gzip_member(gzip.decompress(one).replace(b"\r\nx\r\n", b"\r\ny\r\n")), warc.gzip_member(b"no record")):
        with pytest.raises(warc.BadArchive):
            list(warc.records(bad))


def test_toolcalls(spark):
    calls = spark.createDataFrame(
        [(1, 0, "a", "add", '{"y": 2, "x": 1}', []), (1, 1, "b", "add", '{"x": "1", "y": 2}', ["c"]), (1, 2, "c", "add", '{"x": 1, "y": 2, "z": {"b": 1, "a": [3]}}', ["a", "gone"]), (1, 3, "d", "none", "{}", None), (1, 4, "e", "add", "oops", ["e"]), (1, 5, "a", "add", "{}", []), (1, 6, None, "add", None, [])],
        "conv_id long, seq long, call_id string, name string, arguments string, after array<string>",
    )
    results = spark.createDataFrame([(1, 9, "a", 'is "3"\n'), (1, 8, "a", "first"), (1, 7, "zz", "?")], "conv_id long, seq long, call_id string, content string")
    schemas = spark.createDataFrame([("add", "x", "integer", True), ("add", "y", "integer", True), ("add", "z", "object", False)], "tool string, field string, type string, required boolean")
    got = {(r.call_id, r.seq): r for r in toolcalls.link(calls, results, schemas).collect()}
    assert len(got) == 7 and got["a", 0].json == '{"arguments":{"x":1,"y":2},"id":"a","name":"add","result":"first"}'
    assert got["a", 0].valid and not got["b", 1].valid and got["c", 2].valid and not got["d", 3].valid and not got["e", 4].valid and not got[None, 6].valid
    assert got["a", 0].n_results == 2 and got["c", 2].missing == 1 and got["e", 4].cyclic and not got["b", 1].cyclic and got["a", 5].repeated
    assert got["a", 0].position < got["c", 2].position < got["b", 1].position
    assert json.loads(got["e", 4].json)["arguments"] == "oops" and json.loads(got[None, 6].json) == {"arguments": None, "id": None, "name": "add", "result": None}
    assert [r.call_id for r in toolcalls.orphans(calls, results).collect()] == ["zz"]
    assert toolcalls.link(calls.limit(0), results, schemas).isEmpty()


@pytest.mark.parametrize("links", [0, 50_000])  # as rows, and in one pass
def test_toolcalls_long_chains_and_cycles(spark, monkeypatch, links):
    monkeypatch.setattr(toolcalls, "GROUP_LINKS", links)
    rows = [(1, i, f"a{i}", [f"a{i + 1}"] if i < 19 else []) for i in range(20)]  # each call needs the next one
    rows += [(2, 0, "behind", ["p"]), (2, 1, "p", ["q"]), (2, 2, "q", ["r", "before"]), (2, 3, "r", ["p"]), (2, 4, "before", []), (2, 5, "between", ["r"]), (2, 6, "s", ["t", "between"]), (2, 7, "t", ["s"]), (2, 8, "u", ["u", "s"])]
    calls = spark.createDataFrame(rows, "conv_id long, seq long, call_id string, after array<string>")
    got = {r.call_id: r for r in toolcalls.positions(calls).collect()}
    assert len(got) == len(rows)
    assert {k for k, r in got.items() if r.cyclic} == {"p", "q", "r", "s", "t", "u"}
    apart = [{"p", "q", "r"}, {"s", "t"}, {"u"}]
    for _, _, call, after in rows:
        for need in after:
            assert got[need].position < got[call].position or any({need, call} <= c for c in apart)


def test_toolcalls_of_many_needs_and_long_rings(spark):
    """200 calls that need two later ones each, and a ring of 5,000 with a call behind it, in one pass."""
    import time

    rows = [(1, i, f"a{i}", [f"a{k}" for k in (i + 1, i + 2) if k < 200]) for i in range(200)] + [(2, i, f"r{i}", [f"r{(i + 1) % 5000}"]) for i in range(5000)] + [(2, 0, "behind", ["r4999"])]
    began = time.time()
    got = {(r.conv_id, r.call_id): r for r in toolcalls.positions(spark.createDataFrame(rows, "conv_id long, seq long, call_id string, after array<string>")).collect()}
    assert time.time() - began < 60
    assert [got[1, f"a{i}"].position for i in range(199, -1, -1)] == list(range(199, 399))
    assert all(got[2, f"r{i}"].cyclic and got[2, f"r{i}"].position == i for i in range(5000))
    assert not got[2, "behind"].cyclic and got[2, "behind"].position == 5000


def test_toolcalls_very_long_chain_takes_few_rounds(spark, monkeypatch):
    import time

    monkeypatch.setattr(toolcalls, "GROUP_LINKS", 0)
    rows = [(1, i, f"a{i}", [f"a{i + 1}"] if i < 199 else []) for i in range(200)]
    began = time.time()
    got = {r.call_id: r for r in toolcalls.positions(spark.createDataFrame(rows, "conv_id long, seq long, call_id string, after array<string>")).collect()}
    assert [got[f"a{i}"].position for i in range(199, -1, -1)] == list(range(199, 399)) and not any(r.cyclic for r in got.values())
    assert time.time() - began < 120


@pytest.mark.parametrize("links", [0, 50_000])
def test_toolcalls_against_brute_force(spark, monkeypatch, links):
    """Random graphs: positions as defined, cycles as strongly connected components."""
    monkeypatch.setattr(toolcalls, "GROUP_LINKS", links)
    r = random.Random(3)
    rows = [(c, i, f"c{i}", sorted({f"c{r.randrange(14)}" for _ in range(r.choice([0, 0, 1, 1, 2]))})) for c in range(12) for i in range(12)]
    got = {(x.conv_id, x.call_id): x for x in toolcalls.positions(spark.createDataFrame(rows, "conv_id long, seq long, call_id string, after array<string>")).collect()}
    assert len(got) == len(rows)
    for c in range(12):
        needs = {k: [n for n in after if n in {x[2] for x in rows if x[0] == c}] for conv, _, k, after in rows if conv == c}
        reach = {k: set() for k in needs}
        for k in needs:
            todo = list(needs[k])
            while todo:
                x = todo.pop()
                if x not in reach[k]:
                    reach[k].add(x)
                    todo += needs[x]
        position = {}

        def place(k):
            if k not in position:
                position[k] = max([int(k[1:]), *(place(n) + 1 for n in needs[k] if not (n in reach[k] and k in reach[n]))])
            return position[k]

        for k in needs:
            assert (got[c, k].position, got[c, k].cyclic) == (place(k), k in reach[k])


def test_toolcalls_repeated_rows(spark):
    """Equal calls: one counts, the others are marked, and there are as many rows as before; columns besides may have any names."""
    calls = spark.createDataFrame([(1, 0, "a", "add", "{}", [], "x", 5)] * 3 + [(1, 1, None, "add", "{}", [], "x", 5)] * 2 + [(None, None, "b", "add", "y" * 100_000, None, "x", 5)], "conv_id long, seq long, call_id string, name string, arguments string, after array<string>, position string, rid int")
    results = spark.createDataFrame([(1, 1, "a", "r", "c")], "conv_id long, seq long, call_id string, content string, valid string")
    schemas = spark.createDataFrame([("add", "x", "integer", False)], "tool string, field string, type string, required boolean")
    got = toolcalls.link(calls, results, schemas).collect()
    assert len(got) == 6 and sorted(x.repeated for x in got if x.call_id == "a") == [False, True, True] and not any(x.repeated for x in got if x.call_id is None)
    assert len(json.loads(next(x.json for x in got if x.call_id == "b"))["arguments"]) == 100_000
