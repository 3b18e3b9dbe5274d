"""Tokens, files, archives, media, pages and vectors: exact round trips and brute force, with odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from webstrata.llm import ann_mih, arc_warc, bpe_tree, common, flac_media, html_extract, poisson_mix, token_planes
from webstrata.llm import queries as q

from ..conftest import rows_of

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ALPHABET = ["a", "b", "e", "é", " ", "  ", "\n", "the", "!!", "1", "23", "'s", "'re", "'", "ñ", "日本", "<|endoftext|>", "x" * 7, " \n", "\t", "Ωσ", " ", " ", "😀", "\x1c", "́", "İ", "Σ", "<|startoftext|>", "A", "\x85"]
ODD = [(0, None), (1, ""), (2, "plain text, twice"), (2, "plain text, twice"), (None, "no id <|endoftext|> here"), (9, "  \n "), (8, "word " * 30_000), (7, "a" * 50_000), (6, "日本" * 9_000)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("n_tokens", "ids", "start", "media", "source", "copy_no")})


@pytest.mark.parametrize("leaf", [16, 64, 1000])
def test_tree_is_the_plain_encoding(leaf):
    e, r = bpe_tree.TreeEncoder(BYTE, leaf=leaf, window=8), random.Random(leaf)
    for _ in range(250):
        some = r.sample(ALPHABET, r.randrange(2, len(ALPHABET)))
        text = "".join(r.choice(some) for _ in range(r.randrange(400)))
        ids = np.frombuffer(e.encode([text])[0], "<u4")
        assert ids.tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids
        assert e.decode(ids.tobytes()).decode() == e.tokenizer.decode(ids.tolist(), skip_special_tokens=False)
    for _ in range(60):
        text = "".join(r.choice("etaoinshrdlué") for _ in range(r.randrange(2000)))
        assert np.frombuffer(e.encode([text])[0], "<u4").tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


def test_decode_of_broken_bytes():
    e = bpe_tree.TreeEncoder(BYTE)
    r = random.Random(2)
    for _ in range(200):
        ids = [r.randrange(50257) for _ in range(r.randrange(8))]
        assert e.decode(np.array(ids, "<u4").tobytes()).decode() == e.tokenizer.decode(ids, skip_special_tokens=False)


def test_bpe_query(spark, odd):
    t = Tokenizer.from_file(BYTE)
    want = []
    for i, text in ODD:
        ids = t.encode(text or "", add_special_tokens=False).ids
        want.append((str(i), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = [(str(r["doc_id"]), *tuple(r)[1:]) for r in bpe_tree.bpe_digests(odd).collect()]
    assert sorted(got) == sorted(want)
    assert bpe_tree.bpe_digests(odd.limit(0)).count() == 0
    assert len(bpe_tree.bpe_digests(odd.where("doc_id = 2"), with_ids=True, keep=("source",)).first()["ids"]) > 2


def test_word_encoder():
    w, r = token_planes.WordEncoder(WORD), random.Random(3)
    for _ in range(400):
        text = "".join(r.choice(ALPHABET) for _ in range(r.randrange(60)))
        assert np.frombuffer(next(iter(w.encode([text]))), "<u2").tolist() == w.tokenizer.encode(text, add_special_tokens=False).ids


def test_words_with_control_characters_and_any_space():
    """Every ASCII character, and every character that Python takes for space, between and inside words."""
    w, r = token_planes.WordEncoder(WORD), random.Random(6)
    ascii_, space = [chr(i) for i in range(128)], [chr(i) for i in range(0x110000) if chr(i).isspace()]
    pools = [ascii_, space + list("ab'1é"), [*space, *ascii_, "<|endoftext|>", "<|", "İ", "\u0301", "中"]]
    texts = ["".join(r.choice(r.choice(pools)) for _ in range(r.randrange(40))) for _ in range(600)]
    for text, ids in zip(texts, w.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u2").tolist() == w.tokenizer.encode(text, add_special_tokens=False).ids


def test_words_are_met_once(monkeypatch):
    """Over many chunks each word is handled once, and long ones aren't remembered beyond the bound."""
    monkeypatch.setattr(token_planes, "CHUNK", 200)
    w, r, met = token_planes.WordEncoder(WORD), random.Random(7), []
    monkeypatch.setattr(w, "word", lambda x, one=w.word: met.append(x) or one(x))
    texts = [" ".join(f"{r.choice('abc')}{r.randrange(30)}" for _ in range(r.randrange(30))) for _ in range(200)]
    for text, ids in zip(texts, w.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u2").tolist() == w.tokenizer.encode(text, add_special_tokens=False).ids
    assert len(met) == len(set(met)) == len(w.words)
    w = token_planes.WordEncoder(WORD)
    list(w.encode(["q" * 1000 + " once twice", "twice " + "q" * 1000 + " z" * 100]))
    assert w.words.to_pylist() == ["q" * 1000, "once", "twice", "z"]
    w.forget()
    assert w.words.to_pylist() == ["twice"] and list(w.encode(["z twice q"])) == [w.whole("z") + w.whole("twice") + w.whole("q")]
    monkeypatch.setattr(token_planes, "CACHE_BYTES", 100)
    list(w.encode(["q" * 1000]))
    assert "q" * 1000 not in w.words.to_pylist()


def test_word_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(token_planes, "CACHE_WORDS", 50)
    w, r = token_planes.WordEncoder(WORD), random.Random(4)
    for _ in range(20):
        text = " ".join(f"w{r.randrange(500)}" for _ in range(40))
        assert np.frombuffer(next(iter(w.encode([text]))), "<u2").tolist() == w.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("kind", ["byte", "bit"])
@pytest.mark.parametrize("dtype", ["<u2", "<u4"])
def test_shards(kind, dtype):
    r = np.random.default_rng(5)
    for n in (0, 1, 63, 64, 1000):
        ids = r.integers(0, 50_000, n).astype(dtype)
        s = token_planes.Shard(token_planes.encode_shard(ids, [7, None], [n, 0], kind, block=64))
        assert (s.ids() == ids).all() and s.doc_ids == [7, None] and s.lengths.tolist() == [n, 0]
        for a, b in ((0, 5), (60, 70), (64, 128), (130, 131)):
            assert (s.ids(a, min(b, n)) == ids[a : min(b, n)]).all()


def brute_planes(rows):
    t, at, out = Tokenizer.from_file(WORD), 0, []
    spread = lambda t: np.uint64(xxhash.xxh64(t.encode(), seed=42).intdigest()).astype(np.int64)
    for i, text in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, spread(x[1] or ""), x[1] or "")):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((str(i), at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return sorted(out)


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_planes_query(spark, odd, kind, monkeypatch):
    got = token_planes.token_planes(odd.repartition(3), kind=kind).collect()
    assert sorted((str(r["doc_id"]), *tuple(r)[1:]) for r in got) == brute_planes(ODD)
    assert token_planes.token_planes(odd.limit(0)).count() == 0


def test_shard_files(spark, odd, tmp_path):
    """Files of the format, read in order without Spark; names alone give every shard's place."""
    root = tmp_path / "s"
    shards = token_planes.write_planes(odd.repartition(3), WORD, str(root))
    names = sorted(p.name for p in root.iterdir())
    assert names and all(n.endswith(".bpln") for n in names)
    assert "content" not in shards.select("part", "n_ids")._jdf.queryExecution().executedPlan().toString()
    read = [token_planes.Shard((root / n).read_bytes()) for n in names]
    assert [len(s.ids()) for s in read] == [int(n.rsplit("-", 1)[1].split(".")[0]) for n in names]
    assert sum(len(s.doc_ids) for s in read) == len(ODD)
    t = Tokenizer.from_file(WORD)
    ids = np.concatenate([s.ids() for s in read]).tolist()
    at = 0
    for s in read:
        for n in s.lengths.tolist():
            at += n
            assert ids[at - 1] == 1
    by_id = dict(ODD)
    last = [i for s in read for i in s.doc_ids][-1]
    assert last == 9 and ids[-len(t.encode(by_id[9], add_special_tokens=False).ids) - 1 :][:-1] == t.encode(by_id[9], add_special_tokens=False).ids


def test_no_shard_of_a_failed_job(spark, odd, tmp_path):
    """A document that can't be read fails the job; no file of any task stays."""
    bad = odd.repartition(3).withColumn("text", F.when(F.col("doc_id") == 6, F.raise_error(F.lit("no such text"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="no such text"):
        token_planes.write_planes(bad, WORD, str(tmp_path / "s"))
    assert not [p for p in (tmp_path / "s").rglob("*") if p.is_file()]


def test_wide_vocabularies(monkeypatch):
    monkeypatch.setattr(Tokenizer, "get_vocab_size", lambda self, with_added_tokens=True: 1 << 17, raising=False)
    try:
        w = token_planes.WordEncoder(WORD)
    except TypeError:
        pytest.skip("the library's class can't be patched")
    ids = np.frombuffer(next(iter(w.encode(["some words, 12 <|endoftext|> é"]))), w.dtype)
    assert ids.tolist() == w.tokenizer.encode("some words, 12 <|endoftext|> é", add_special_tokens=False).ids


def test_arc_versions():
    for version in (1, 2):
        block = arc_warc.arc_version_block(version, "a.arc")
        body = b"HTTP/1.0 200 OK\r\nX: y\r\n\r\n\n\nbody with 2 0 numbers\n"
        recs = list(arc_warc.parse_arc(block + arc_warc.arc_record(version, "http://x/a b\nc", "20010203040506", 200, body, "a.arc", 3) + arc_warc.arc_record(version, "dns:x", "200102030405", 200, b"1.2.3.4", "a.arc", 9)))
        assert [r.version for r in recs] == [version] * 3 and recs[1].body == body and recs[1].header["url"] == "http://x/a%20b%0Ac"
        fields, out = arc_warc.parse_warc(arc_warc.to_warc(recs[1], page=7))
        assert out == body and fields["warc-type"] == "response" and fields["warc-date"] == "2001-02-03T04:05:06Z"
        assert fields["warc-payload-digest"] == "sha256:" + hashlib.sha256(body.split(b"\r\n\r\n", 1)[1]).hexdigest()
        assert [arc_warc.warc_type(r) for r in recs] == ["warcinfo", "response", "resource"]
        assert arc_warc.parse_warc(arc_warc.to_warc(recs[2]))[0]["warc-date"] == "2001-02-03T04:05:00Z"
    old = b"http://x/ 1.1.1.1 19960101 text/html; charset=a b 3\nabc\n"
    assert next(arc_warc.parse_arc(old)).header["type"] == "text/html; charset=a b"
    for bad in (b"http://x/ 1 2 t 99\nabc", b"short 1\n", b"a b c d", b"http://x/ 1.1.1.1 1996 t -1\nabc"):
        with pytest.raises(ValueError):
            list(arc_warc.parse_arc(bad))
    with pytest.raises(ValueError):
        arc_warc.parse_warc(arc_warc.to_warc(recs[1]).replace(b"body", b"bady"))


def test_archives(spark):
    same = "é" * 60
    rows = [(5, "http://a/", same), (3, "http://b/ x", same), (4, None, same), (3, "http://b/ x", same), (None, "u", same), (6, "s", "small"), (7, "s", "small"), (8, "n", None), (9, "", ""), (10, "big", "z" * 3_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(0))
    got = arc_warc.convert_pages(pages).collect()
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        ref = 3 if h == same and i != 3 else None
        want.append((str(i), len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if ref else "response", str(ref)))
    assert sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], str(r["refers_to"])) for r in got) == sorted(want)
    assert arc_warc.convert_pages(pages.limit(0)).count() == 0
    ids = {r["record_id"]: r for r in got}
    for r in got:
        # standard fields resolve a revisit without the page ids
        if r["record_type"] == "revisit":
            first = ids[r["refers_to_id"]]
            assert (first["page_id"], first["record_type"], first["payload_digest"]) == (3, "response", r["payload_digest"])
        else:
            assert r["refers_to_id"] is None


def test_revisits_alike_however_they_are_joined(spark, monkeypatch):
    rows = [(i, f"u{i % 3}", "x" * (99 + i % 4)) for i in range(40)] + [(None, "n", "x" * 200), (None, "n", "x" * 200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    few = sorted(map(str, arc_warc.with_revisits(pages).collect()))
    monkeypatch.setattr(arc_warc, "BROADCAST_GROUPS", 0)
    assert sorted(map(str, arc_warc.with_revisits(pages).collect())) == few


def test_archive_files_of_others(spark, tmp_path):
    block = arc_warc.arc_version_block(1, "a.arc") + arc_warc.arc_record(1, "http://x/", "20010203040506", 200, b"HTTP/1.0 200 OK\r\n\r\nbody", "a.arc", 0) + arc_warc.arc_record(1, "dns:x", "2001", 200, b"1.2.3.4", "a.arc", 0)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.arc").write_bytes(block)
    warcs = arc_warc.convert_arcs(spark.read.format("binaryFile").load(str(tmp_path / "in")).withColumnRenamed("content", "arc"))
    common.export_files(warcs.select(F.lit("a.warc").alias("name"), "blob"), str(tmp_path / "out"))
    files = spark.read.format("binaryFile").load(str(tmp_path / "out")).withColumnRenamed("content", "blob")
    got = sorted((r["target_uri"], r["payload_bytes"], r["record_type"], r["page_id"]) for r in arc_warc.read_archives(files).collect())
    assert got == [("dns:x", 7, "resource", None), ("http://x/", 4, "response", None)]
    import gzip

    foreign = gzip.compress(b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Block-Digest: sha1:ABC\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n")
    rows = spark.createDataFrame([(bytearray(foreign),), (bytearray(),), (None,)], "blob binary")
    assert [(r["payload_bytes"], r["record_id"]) for r in arc_warc.read_archives(rows).collect()] == [(3, None)]


def test_pages_named_as_version_blocks_stay_pages(spark):
    rows = [(1, "filedesc://a.arc", "one"), (2, "filedesc:", "é" * 80), (3, "filedesc:x y", "é" * 80), (4, "http://a/", "1 0 four")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    got = {(r["page_id"], r["payload_bytes"], r["record_type"], r["target_uri"]) for r in arc_warc.convert_pages(pages).collect()}
    assert got == {(1, 3, "response", "filedesc://a.arc"), (2, 160, "response", "filedesc:"), (3, 160, "revisit", "filedesc:x%20y"), (4, 8, "response", "http://a/")}


def payloads():
    r = random.Random(6)
    yield from (b"\0" * 64, bytes(range(256)) * 5, b"a" * 4096, bytes([0, 255] * 512), bytes(r.randrange(256) for _ in range(64 * 40)))
    yield bytes(int(128 + 100 * math.sin(i / 9)) for i in range(3072))
    yield b"\x80" * 64 + bytes(r.choice([0, 128, 255]) for _ in range(960))
    yield from (flac_media.payload("the quick brown é " * k)[1] for k in (1, 50, 700))


def test_media_round_trip():
    data = list(payloads())
    ranked = flac_media.encode_streams(data, levels="ranks")
    assert flac_media.decode_streams(ranked) == data and flac_media.seek(ranked[1], 7, 99) == data[1][7:99]
    assert len(ranked[-1]) < len(flac_media.encode_streams(data[-1:])[0])
    streams = flac_media.encode_streams(data)
    assert flac_media.decode_streams(streams) == data
    assert [flac_media.encode_streams([d])[0] for d in data] == streams  # equal texts, equal streams, whatever stands beside them
    kinds = {flac_media.read_header(f).kind for s in streams for f in flac_media.open_stream(s).frames()}
    assert {0, 1} <= kinds and any(8 <= k <= 12 for k in kinds) and any(k >= 32 for k in kinds)
    for a, b in ((0, 64), (1000, 1100), (1023, 1025), (2559, 2560)):
        assert flac_media.seek(streams[4], a, b) == data[4][a:b]


class Writer:
    """Bits of a frame, for streams that the writer under test never makes."""

    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> (n - 1 - i) & 1 for i in range(n)]

    def bytes(self):
        self.bits += [0] * (-len(self.bits) % 8)
        return np.packbits(self.bits).tobytes()


def slow_crc(data, poly, bits):
    c = 0
    for byte in data:
        c ^= byte << (bits - 8)
        for _ in range(8):
            c = (c << 1 ^ poly if c >> (bits - 1) else c << 1) & ((1 << bits) - 1)
    return c


def foreign_subframe(w, r, s, depth):
    """Any subframe form that holds the samples."""
    wasted = 0
    while all(x % (2 << wasted) == 0 for x in s) and any(s):
        wasted += 1
    s, depth = [x >> wasted for x in s], depth - wasted
    kind = 0 if len(set(s)) == 1 else r.choice([1, 8, 9, 10, 11, 12, 33, 35, 39])
    order = kind - 31 if kind >= 32 else kind - 8 if kind >= 8 else 0
    w.put(0, 1), w.put(kind, 6), w.put(bool(wasted), 1)
    if wasted:
        w.put(1, wasted)
    if kind < 8:
        for x in s if kind else s[:1]:
            w.put(x, depth)
        return
    for x in s[:order]:
        w.put(x, depth)
    coefs, shift = {8: [], 9: [1], 10: [2, -1], 11: [3, -3, 1], 12: [4, -6, 4, -1]}.get(kind, []), 0
    if kind >= 32:
        precision, shift = r.randrange(5, 13), r.randrange(0, 9)
        coefs = [r.randrange(-(1 << precision - 1), 1 << precision - 1) >> 2 for _ in range(order)]
        w.put(precision - 1, 4), w.put(shift, 5)
        for c in coefs:
            w.put(c, precision)
    rest = [x - (sum(c * s[i - 1 - j] for j, c in enumerate(coefs)) >> shift) for i, x in enumerate(s)][order:]
    method = r.randrange(2)
    parts = r.choice([p for p in (0, 1, 2, 3) if len(s) % (1 << p) == 0 and len(s) >> p > order])
    w.put(method, 2), w.put(parts, 4)
    at = 0
    for p in range(1 << parts):
        n = (len(s) >> parts) - (order if p == 0 else 0)
        part, at = rest[at : at + n], at + n
        wide = max(x.bit_length() for x in [*part, 0]) + 1
        if wide < 32 and r.random() < 0.4:
            w.put((1 << 4 + method) - 1, 4 + method), w.put(wide, 5)
            for x in part:
                w.put(x, wide)
        else:
            k = min(max(0, wide - 3), 30 if method else 14)
            w.put(k, 4 + method)
            for x in part:
                u = x * 2 if x >= 0 else -x * 2 - 1
                w.put(1, (u >> k) + 1), w.put(u, k) if k else None


def foreign_stream(r, channels, depth, sizes, assignment, points=False, known=True):
    """(stream, samples by channel)"""
    frames, every, at, table = b"", [[] for _ in range(channels)], 0, b""
    for i, size in enumerate(sizes):
        top = 1 << depth - 1
        s = [[max(-top, min(top - 1, int(top / 3 * math.sin(k / (3 + c)) + r.randrange(-5, 6)))) for k in range(size)] for c in range(channels)]
        if i % 3 == 1:
            s = [[(x >> 2) << 2 for x in c] for c in s]
        if i % 4 == 3:
            s[0] = [7] * size
        code = assignment if channels == 2 and assignment > 7 else channels - 1
        coded = s
        if code == 8:
            coded = [s[0], [a - b for a, b in zip(*s)]]
        elif code == 9:
            coded = [[a - b for a, b in zip(*s)], s[1]]
        elif code == 10:
            coded = [[(a + b) >> 1 for a, b in zip(*s)], [a - b for a, b in zip(*s)]]
        head = bytes([0xFF, 0xF9, 0x7D, code << 4 | {8: 1, 12: 2, 16: 4, 20: 5, 24: 6}[depth] << 1]) + chr(at).encode() + (size - 1).to_bytes(2) + (44100).to_bytes(2)
        w = Writer()
        for c, x in enumerate(coded):
            foreign_subframe(w, r, x, depth + ((code, c) in ((8, 1), (9, 0), (10, 1))))
        frame = head + bytes([slow_crc(head, 7, 8)]) + w.bytes()
        table += at.to_bytes(8) + len(frames).to_bytes(8) + size.to_bytes(2)
        frames += frame + slow_crc(frame, 0x8005, 16).to_bytes(2)
        at += size
        for c in range(channels):
            every[c] += s[c]
    raw = b"".join(x.to_bytes(-(-depth // 8), "little", signed=True) for row in zip(*every) for x in row)
    info = (16).to_bytes(2) + (4096).to_bytes(2) + bytes(6) + (44100 << 44 | channels - 1 << 41 | depth - 1 << 36 | (at if known else 0)).to_bytes(8) + (hashlib.md5(raw).digest() if known else bytes(16))
    blocks = (0 if points else 0x80000000).__or__(len(info)).to_bytes(4) + info + ((0x83000000 | len(table)).to_bytes(4) + table if points else b"")
    return b"fLaC" + blocks + frames, raw


@pytest.mark.parametrize("channels, depth, assignment", [(1, 8, 0), (1, 16, 0), (1, 24, 0), (2, 8, 1), (2, 16, 8), (2, 16, 9), (2, 16, 10), (2, 24, 10), (2, 12, 8), (3, 20, 0)])
def test_foreign_streams(channels, depth, assignment):
    r = random.Random(depth * channels + assignment)
    own = flac_media.encode_streams([b"own words " * 300])[0]
    for points, known in ((False, True), (True, True), (False, False)):
        stream, raw = foreign_stream(r, channels, depth, [64, 128, 40, 256, 16, 200], assignment, points, known)
        got, mine = flac_media.stream_blocks([stream, own])
        assert (got.channels, got.bits) == (channels, depth) and b"".join(x for _, _, x in got.blocks) == raw
        assert [n for _, n, _ in got.blocks] == [64, 128, 40, 256, 16, 200] and mine == flac_media.stream_blocks([own])[0]
        wide = channels * -(-depth // 8)
        for a, b in ((0, 10), (63, 65), (200, 500), (700, 704)):
            assert flac_media.seek_pcm(stream, a, b) == raw[a * wide : b * wide]
        broken = bytearray(stream)
        broken[-9] ^= 16
        with pytest.raises(ValueError):
            flac_media.stream_blocks([bytes(broken)])


def test_media_columns_of_any_streams(spark):
    stream, raw = foreign_stream(random.Random(3), 2, 16, [64, 96], 10)
    media = spark.createDataFrame([(1, bytearray(stream)), (2, None)], "doc_id long, media binary").withColumn("n_bytes", F.lit(1).cast("long"))
    rows = flac_media.pcm_blocks(media).orderBy("first_sample").collect()
    assert [(r["first_sample"], r["n_samples"], r["channels"], r["bits"], r["levels"]) for r in rows] == [(0, 64, 2, 16, "plain"), (64, 96, 2, 16, "plain")] and b"".join(bytes(r["pcm"]) for r in rows) == raw
    assert flac_media.media_features(media.where("media is null")).count() == 0


def test_media_damage_is_seen():
    stream = bytearray(flac_media.encode_streams([flac_media.payload("some words here " * 200)[1]])[0])
    first = flac_media.open_stream(bytes(stream)).first
    for at in (first + 5, first + 100, len(stream) - 1):
        broken = bytearray(stream)
        broken[at] ^= 4
        with pytest.raises(ValueError):
            flac_media.decode_streams([bytes(broken)])


def test_checksums():
    r = random.Random(7)
    data = sorted((bytes(r.randrange(256) for _ in range(r.randrange(1, 40))) for _ in range(30)), key=len, reverse=True)
    rows = np.frombuffer(b"".join(d.ljust(40, b"\0") for d in data), np.uint8).reshape(30, 40)
    assert flac_media.crc16(rows, np.array([len(d) for d in data])).tolist() == [slow_crc(d, 0x8005, 16) for d in data]
    assert [flac_media.crc8(d) for d in data] == [slow_crc(d, 7, 8) for d in data]
    assert all(flac_media.coded_number(n) == chr(n).encode() for n in (0, 127, 128, 2047, 2048, 65535, 65536))


def test_media_query(spark, odd):
    got = flac_media.media_features(flac_media.to_media(odd)).collect()
    assert len(got) == len(ODD) and flac_media.to_media(odd.limit(0)).count() == 0
    by = {}
    for i, text in ODD:
        raw = (text or "").encode()
        full = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        by[hashlib.sha256(full).hexdigest()] = (len(full), zlib.crc32(full[-64:]))
    for r in got:
        assert by[r["payload_sha256"]] == (r["payload_bytes"], r["tail_crc32"]) and r["n_bytes"] <= r["payload_bytes"]
    same = [r for r in got if r["doc_id"] == 2]
    assert len(same) == 2 and same[0] == same[1]
    blocks = flac_media.pcm_blocks(flac_media.to_media(odd.where("doc_id = 8"), levels="plain")).orderBy("first_sample").collect()
    assert b"".join(bytes(b ^ 0x80 for b in r["pcm"]) for r in blocks).rstrip(b"\0").decode() == dict(ODD)[8]
    assert [r["first_sample"] for r in blocks] == list(range(0, 1024 * len(blocks), 1024))
    ranked = flac_media.pcm_blocks(flac_media.to_media(odd.where("doc_id = 8"))).orderBy("first_sample").collect()
    assert b"".join(flac_media.to_payload(bytes(r["pcm"]), r["levels"]) for r in ranked).rstrip(b"\0").decode() == dict(ODD)[8]


def test_media_are_stored_and_read_back(spark, odd, tmp_path, monkeypatch):
    odd.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    features = flac_media.media_features
    monkeypatch.setattr(flac_media, "media_features", lambda media: seen.append(media) or features(media))
    got = q.op6_flac_media(spark, str(tmp_path)).collect()
    assert sorted(map(str, got)) == sorted(map(str, features(flac_media.to_media(odd)).collect()))
    files = seen[0].inputFiles()
    assert files and all("/media-" in f for f in files)
    assert sum(len(r["media"]) for r in spark.read.parquet(*files).collect()) == sum(r["media_bytes"] for r in got)


def test_seek_table_is_verified():
    stream = flac_media.encode_streams([flac_media.payload("some words here " * 200)[1]])[0]
    (first, second, *_) = flac_media.open_stream(stream).points
    entry = second[0].to_bytes(8) + second[1].to_bytes(8)
    assert first[0] == 0 and stream.count(entry) == 1
    with pytest.raises(ValueError):
        flac_media.decode_streams([stream.replace(entry, (second[0] + 1).to_bytes(8) + second[1].to_bytes(8))])


def test_best_run_is_the_maximum():
    r = random.Random(8)
    for _ in range(300):
        n = r.randrange(1, 14)
        found = [html_extract.Token(k, 1 if k.startswith("w:") else 0, "x" if k.startswith("w:") else "", k, False) for k in r.choices(["w:p", "w:a", "li", "p"], k=n)]
        weights = {"w:p": 2.0, "w:a": 0.05, "li": -3.0, "p": -0.5}
        score = lambda a, b: sum(weights[t.key] for t in found[a:b])  # noqa: B023, E731
        best = max([0.0, *(score(a, b) for a in range(n) for b in range(a, n + 1))])
        a, b = html_extract.best_run(found, weights)
        assert abs(score(a, b) - best) < 1e-9


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><nav><a href=/>home</a> <a href=/b>b</a></nav><div class="ad banner">buy this</div>
<article><h1>Head &amp; line</h1><p>One <b>bo</b>ld&nbsp;word<script>if (a < b) "</p>"</script> and
 more text of the article that goes on.</p><aside>aside text</aside><form><input> field</form><p>Second paragraph &lt;tag&gt; of text, quite long too.<br>After</p>
<div class="comments">first! <div>nested</div> spam</div><p>Last words of the article stand here.</p></article><footer>foot words here</footer></body></html>"""


def test_main_text(spark):
    sf = "/root/testdata/sf0.001"
    weights = html_extract.learn(spark.read.parquet(f"{sf}/pages.parquet"))
    text = html_extract.main_text(PAGE, weights)
    assert text == "Head & line One bold word and more text of the article that goes on. Second paragraph <tag> of text, quite long too. After Last words of the article stand here."
    assert html_extract.main_text("", weights) == "" and html_extract.main_text("<p", weights) in ("", "<p") and html_extract.main_text("<!-- x", weights) == ""
    rows = [(1, "u", None), (None, None, ""), (2, "u", PAGE), (2, "u", PAGE), (3, "u", "<p>" + "word " * 100_000)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)), weights).collect()
    assert sorted((str(r["page_id"]), r["n_chars"]) for r in got) == sorted([("1", 0), ("None", 0), ("2", len(text)), ("2", len(text)), ("3", 499_999)])


@pytest.mark.parametrize(
    "inner, want",
    [
        ('<p class="ad">Buy<p>Text</p><p>More</p>', "Text More"),
        ('<p class="ad">Buy <b>now<div>Text</div>', "Text"),
        ('<div><p class="ad">Buy</div>Text', "Text"),
        ('<ul><li>one<li class="share">tell<li>two</ul>Text', "one two Text"),
        ('<ul><li class="share">tell<ul><li>all<li>of</ul>them<li>two</ul>Text', "two Text"),
        ('<dl><dt class="promo">a<dd>b<dt>c<dd class="promo">d</dl>Text', "b c Text"),
        ('<table><tr><td class="ad">a<td>b<tr class="promo"><td>c<tr><td>d</table>Text', "b d Text"),
        ('<table><tr><td class="ad">a<table><tr><td>b</table>c</table>Text', "Text"),
        ('<p>One</p><div><form>a<p>b</p></div>Text', "One Text"),
        ('<section><aside>a<div>b</div></section>Text', "Text"),
        ('<div><aside>a</p></span>b</aside>Text</div>', "Text"),
        ('<p class="ad"><span>a</p>Text<span class="ad">b<b>c</span></b>d', "Textbcd"),
        ('<div class="ad">a<div>b</div>c</div>Text<nav><ul><li>d</ul></nav>e', "Text e"),
        ('<datalist><option class="ad">a<option>b</datalist>Text', "b Text"),
        ("<p class=notice>cookie<p>Text", "Text"),
        ('<div class="entry has-sidebar">Text <b class="related-term">more</b> words</div>', "Text more words"),
        ('<div class="comments-closed">Text</div><div class="cookie-notice">a</div><div class="x comments">b</div>', "Text"),
        ('<section class="related-work">A</section><div class="social-history">B</div><div class="share-price">C</div>', "A B C"),
        ('<blockquote class="public-notice">A</blockquote><section class="river-navigation">B</section><p id="notice">C</p>', "A B C"),
        ("Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be<object>shown</object><canvas>drawn</canvas>", "Let x=1 be shown drawn"),
        ("R&am<b>p;</b>D &am<!-- -->p; R&amp;D", "R&amp;D &amp; R&D"),
        ("<p title=it's>Text</p> it's", "Text it's"),
        ('<p title="it\'s > 1" class=x>Text</p>', "Text"),
        ('<p title="no end>Text</p> and', "Text and"),
        ("Te<img src=x>xt<br>a<hr>b", "Text a b"),
        ("<form><p>all paragraphs of the page</p><p>and more</p></form>Text", "all paragraphs of the page and more Text"),
        ("<form>many words that hold most of the page but no paragraph</form><p>Text</p>", "Text"),
        ("<noscript>a</noscript><svg><title>b</title></svg><iframe>c</iframe>Text", "Text"),
        ("<svg><path>a</path></svg>Text", "Text"),
        ("a < b and 3 <4 </ x>Text<!-- c -- d --><!-->e<? f ?>", "a < b and 3 <4 Texte"),
        ("<TITLE>a</TiTle >Text<x-y-" + "z" * 200 + ">b</x>", "Text b"),
    ],
)
def test_elements_left_out_end_where_html_ends_them(inner, want):
    page = "<div>Start " + inner + " End</div>"
    everything = {t.key: 1.0 if t.words else 0.01 for t in html_extract.tokens(page)}
    assert html_extract.main_text(page, everything) == f"Start {want} End"


def test_class_words_are_learnt_from_other_pages(spark):
    """Words seen beside labelled articles go, those seen inside stay, whatever a list would say; the pages tried don't teach."""
    page = lambda k, inner="": f"""<div class="page wide"><div class="taboola">Tale {k}</div><div class="gdpr-bar x{k}">Agree</div><article><h1>Title {k}</h1><p class="lead">Some words of the article {k} that go on.</p>
        <div class="sidebar">Told aside {k}</div>{inner}<p>And more words here.</p></article><section class="reader-feedback discussion">Said {k}</section></div>"""  # noqa: E731
    train = spark.createDataFrame([(page(k),) for k in range(80)], "html string")
    weights = html_extract.learn(train)
    tried = page(99, '<div class="taboola">Buy</div><div class="discussion">No!</div><div class="gdpr-bar">Yes</div><div class="wide">Wide</div><div class="unheard">New</div>')
    assert html_extract.main_text(tried, weights) == "Title 99 Some words of the article 99 that go on. Told aside 99 Wide New And more words here."
    assert "c:x7" not in weights and "c:page" not in weights and weights["c:sidebar"] > 0 > weights["c:taboola"]


def test_labelled_pages_that_did_not_teach(spark):
    import html
    import re

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    weights = html_extract.learn(pages.where("page_id % 2 = 0"))
    for r in html_extract.extract(pages.where("page_id % 2 = 1"), weights).join(pages.select("page_id", "html"), "page_id").collect():
        inner = re.search(r"(?s)<article>(.*?)</article>", r["html"]).group(1)
        assert r["text"] == " ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", inner))).split())


@pytest.mark.parametrize("piece", ['<a "', "<a b='", "<a b=", "<", "<!-- ", "</", "<script>", "<title>", "<p class=ad>", "&", "<a b=\"c", "<div class='ad'>x"])
def test_broken_pages_take_linear_time(piece):
    import time

    began = time.perf_counter()
    for end in ("", ">", "</p>"):
        assert html_extract.main_text(piece * (1_000_000 // len(piece)) + end, {}) is not None
    assert time.perf_counter() - began < 60


def test_long_names_have_no_weight_of_their_own(spark):
    names = ["x" * 90 + str(i) for i in range(5)]
    page = "".join(f"<{n}>" for n in names) + "<article><p>some words</p></article>"
    found = html_extract.learn(spark.createDataFrame([(page,)], "html string"))
    assert set(found) == {"other", "article", "/article", "p", "/p", "w:p"} - {"article"} | ({"article"} & set(found))


def test_deep_pages_take_linear_time():
    page = "<p>a" + "<button><li class=ad>x<div></span>" * 30_000 + "</section></div>" * 30_000
    assert html_extract.main_text(page, {}) is not None


def test_pages_query(spark, sf_dir):
    import html
    import re

    for r in q.op5_html_extract(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"), "page_id").collect():
        inner = re.search(r"(?s)<article>(.*?)</article>", r["html"]).group(1)
        assert r["text"] == " ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", inner))).split())
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def brute_nearest(rows, k=5):
    ok = {i: np.array(v, float) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for i in ok:
        if i % 50 == 0:
            cos = {j: float(ok[i] @ ok[j] / np.linalg.norm(ok[i]) / np.linalg.norm(ok[j])) for j in ok if j != i}
            out[i] = sorted(cos.items(), key=lambda x: (-round(x[1], 12), x[0]))[:k]
    return out


def test_search_recall_and_ties(spark):
    r = np.random.default_rng(9)
    base = r.normal(size=(20, 16))
    rows = [(i, [float(np.float32(x)) for x in base[i % 20] + (0 if i % 7 == 0 else 0.3) * r.normal(size=16)]) for i in range(600)]
    rows += [(1000, None), (1001, [0.0] * 16), (1050, [float("nan")] * 16), (1100, [None] + [1.0] * 15), (1150, []), (None, rows[0][1]), (600, rows[50][1]), (600, rows[50][1])]
    vectors = ann_mih.usable(spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit(1)))
    got = {}
    for x in ann_mih.search(vectors, vectors.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["vec_id"], x["score"]))
    want = brute_nearest(rows)
    assert set(got) == set(want)
    hit = sum(len({j for j, _ in want[i]} & {j for _, j, _ in got[i]}) for i in want)
    assert hit >= 0.9 * sum(map(len, want.values()))
    for i, found in got.items():
        assert [n for n, _, _ in found] == list(range(1, len(found) + 1))
        assert [(-round(s, 12), j) for _, j, s in found] == sorted((-round(s, 12), j) for _, j, s in found)
        assert all(j != i for _, j, _ in found)


def test_search_of_few(spark):
    few = ann_mih.usable(spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>"))
    assert [(r["rank"], r["vec_id"]) for r in ann_mih.search(few, few.where("vec_id = 0"), target=1.0).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    none = few.limit(0)
    assert ann_mih.search(none, none).count() == 0


def test_search_of_every_length(spark):
    r = np.random.default_rng(3)
    rows = [(i, r.normal(size=8 if i < 90 else 4 if i < 250 else 3).tolist()) for i in range(251)]
    vectors = ann_mih.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = {}
    for x in ann_mih.search(vectors, vectors.where("vec_id % 50 = 0"), target=1.0).collect():
        got.setdefault(x["query_id"], set()).add(x["vec_id"])
    assert set(got) == {0, 50, 100, 150, 200}  # 250 has no other of its length
    for i, found in got.items():
        want = brute_nearest([x for x in rows if len(x[1]) == len(rows[i][1])])[i]
        assert len({j for j, _ in want} & found) >= 4 and len(found) == 5


@pytest.mark.parametrize("lone", [0, 16, 60])
def test_search_fills_every_query(spark, lone):
    r = np.random.default_rng(13)
    centres = r.standard_normal((50, 32))
    tight = centres[np.arange(2000) % 50] + 0.02 * r.standard_normal((2000, 32))
    v = np.concatenate([r.standard_normal((lone, 32)), tight])
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    vectors = ann_mih.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    asked = [*range(lone), *range(lone, len(v), 97)]
    got = {}
    for x in ann_mih.search(vectors, vectors.where(F.col("vec_id").isin(asked))).collect():
        got.setdefault(x["query_id"], []).append(x["rank"])
    assert {i: sorted(n) for i, n in got.items()} == {i: [1, 2, 3, 4, 5] for i in asked}
    few = vectors.where("vec_id < 4 or vec_id = 900")
    assert few.count() == 5 and ann_mih.search(few, few).groupBy("query_id").count().where("count <> 4").count() == 0
    assert ann_mih.search(few, few).select("query_id").distinct().count() == 5


def test_probe_finds_every_code_in_the_radius():
    r = np.random.default_rng(10)
    codes = r.integers(0, 1 << 16, (500, 4)).astype(np.uint16)
    codes[100:140] = codes[100]
    queries = codes[:120:6] ^ np.packbits(r.random((20, 64)) < 0.1, axis=1).view(np.uint16)
    lists = [ann_mih.Index(codes, j) for j in range(4)]
    for radius in (0, 3, 7, 9, 20, 33, 64):
        c = ann_mih.Codes(np.zeros((64, 64)), radius)
        far = np.bitwise_count(queries[:, None, :] ^ codes[None]).sum(axis=2)
        for q, d in zip(queries, far, strict=True):
            found = np.concatenate([x.within(q, c)[0] for x in lists])
            assert sorted(found.tolist()) == np.flatnonzero(d <= radius).tolist()  # every one, and once


def test_index_compares_few_codes_where_neighbours_are_close():
    r = np.random.default_rng(14)
    centres = r.standard_normal((400, 64))
    x = ann_mih.unit_rows(centres[np.arange(8000) % 400] + 0.05 * r.standard_normal((8000, 64)))
    c = ann_mih.fit(x)
    code = c.encode(x)
    lists = [ann_mih.Index(code, j) for j in range(c.substrings)]
    compared = retrieved = right = 0
    for i in range(0, 8000, 50):
        hits = [n.within(code[i], c) for n in lists]
        compared += sum(n for _, n in hits)
        found = np.concatenate([h for h, _ in hits])
        retrieved += len(found)
        near = np.argsort(-(x @ x[i]))[1:6]
        right += len(set(near.tolist()) & set(found.tolist()))
    assert compared < 0.05 * 160 * 8000 and retrieved < 0.02 * 160 * 8000 and right >= 0.9 * 800


def test_recall_on_the_embeddings_table(spark):
    sf = "/root/testdata/sf0.1"
    got = {}
    for x in q.op1_ann_mih(spark, sf).collect():
        got.setdefault(x["query_id"], set()).add(x["vec_id"])
    want = brute_nearest([tuple(x) for x in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()])
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    assert sum(len({j for j, _ in want[i]} & got[i]) for i in want) >= 0.9 * sum(map(len, want.values()))


def test_blocks_change_nothing(spark):
    r = np.random.default_rng(15)
    rows = [(i, r.standard_normal(20).tolist()) for i in range(700)] + [(1000 + i, [1.0] * 20) for i in range(300)] + [(7, [9.0] * 20), (50, [1.0] * 20), (50, [-9.0] * 20)]
    vectors = ann_mih.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    asked = vectors.where("vec_id % 50 = 0")
    whole = ann_mih.search(vectors, asked).collect()
    assert sorted(map(str, ann_mih.search(vectors.repartition(5), asked, block=16).collect())) == sorted(map(str, whole))
    best = {(x["query_id"], x["rank"]): (x["vec_id"], x["score"]) for x in whole}
    assert best[1000, 1][0] == 1001 and best[1050, 1][0] == 1000 and best[50, 1][0] not in range(1000, 1300)


def test_mixing(spark):
    rows = [(i, "x" * (1 + i % 9), ["a", "a", "a", "b", None][i % 5]) for i in range(4000)] + [(5000, None, "a"), (5001, "", "b"), (5002, None, "empty"), (None, "nn", "a"), (7, "x", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit(1) for c in ("rate", "steps", "cdf", "mix_id", "copy_no")})
    weights = spark.createDataFrame([("a", 0.5), ("a", 0.5), ("b", 2.0), (None, 1.0), ("empty", 3.0), ("absent", 1.0)], "source string, weight double")
    out = poisson_mix.mix_sources(docs, weights, epochs=2.0).cache()
    chars = {r["source"]: r["n"] for r in out.groupBy("source").agg(F.sum(F.length("text")).alias("n")).collect()}
    total = sum(len(t or "") for _, t, _ in rows) * 2
    for s, share in (("a", 0.25), ("b", 0.5), (None, 0.25)):
        assert abs(chars[s] / total - share) < 0.04
    assert out.where("source = 'empty'").count() == 0
    per = {r["doc_id"]: (r["n"], r["m"]) for r in out.where("doc_id <> 7").groupBy("doc_id").agg(F.count("*").alias("n"), F.max("copy_no").alias("m")).collect()}
    assert all(n == m for n, m in per.values())
    again = poisson_mix.mix_sources(docs.repartition(7), weights, epochs=2.0)
    assert again.exceptAll(out).count() == 0 and out.exceptAll(again).count() == 0
    keys = [r["shuffle_key"] for r in again.collect()]
    assert keys == sorted(keys)
    assert poisson_mix.mix_sources(docs.limit(0)).count() == 0


def test_no_source_repeats_more_than_it_may(spark):
    """A tiny source beside long ones: its rate is held, the other's stays, and by default nothing is held."""
    docs = spark.createDataFrame([(0, "tiny", "t"), *((i, "long text " * 500, "l") for i in range(1, 200))], "doc_id long, text string, source string")
    rates = lambda **more: {r["mix_source"]: (r["rate"], r["steps"]) for r in poisson_mix.source_rates(docs, **more).collect()}
    free, held = rates(), rates(most_repeats=20)
    assert free["t"][0] > 100 and held == {"t": (20.0, 2), "l": free["l"]}
    assert rates(most_repeats=1e9) == free and rates(most_repeats=0) == {}
    assert poisson_mix.mix_sources(docs, most_repeats=20).where("source = 't'").count() < 60
    assert poisson_mix.mix_sources(docs, most_repeats=0).count() == 0


def test_poisson_counts_follow_the_distribution(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("xy").alias("text"), F.lit("s").alias("source"))
    for rate in (0.7, 40.0):
        small = docs.limit(20_000 if rate < 1 else 2_000)
        n = poisson_mix.mix_sources(small, epochs=rate).groupBy("doc_id").count().toPandas()["count"].to_numpy()
        full = np.concatenate([n, np.zeros(small.count() - len(n))])
        assert abs(full.mean() - rate) < 0.05 * rate and abs(full.var() - rate) < 0.1 * rate


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_sql(spark, sf_dir, duck, name):
    got, want = q.QUERIES[name](spark, sf_dir).toPandas(), duck.sql(q.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = docs
    for name, stage in p.STAGES[:-1]:
        seen = stage(spark, seen, sf_dir)
        assert seen.columns == docs.columns, name
    assert [n for n, _ in p.STAGES] == ["quality", "near_duplicates", "passages", "mixing", "tokens"]
    out = p.run(spark, sf_dir)
    assert 0 < out.count() < 3 * docs.count() and out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert p.run(spark, sf_dir).exceptAll(out).count() == 0


@pytest.mark.parametrize("rows", ["none", "odd"])
def test_pipeline_on_odd_tables(spark, sf_dir, tmp_path, rows):
    """No documents; null, empty, repeated, very long ones, null and repeated ids, clashing columns, no labels."""
    import corpus_pipeline as p

    r = random.Random(17)
    text = lambda n: " ".join(f"W{r.randrange(9000)}" for _ in range(n))
    same, long = text(80), text(40_000)
    made = [] if rows == "none" else [(1, None), (2, ""), (3, " \n "), (4, same), (4, same), (None, same), (5, same + " " + text(70)), (None, text(60)), (-7, "é " * 30), (6, long), (2**62, text(9)), (8, text(200)), (8, text(30))]
    docs = spark.createDataFrame([(i, t, "en", None if i == 5 else "s", len(t or "")) for i, t in made], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.lit("x") for c in ("score", "row", "c1", "cid", "copy_no", "n_tokens", "cut_row", "class_id", "ord")})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = p.run(spark, str(tmp_path)).collect()
    if rows == "none":
        assert out == []
        return
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in p.STAGES[:3]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns, name
    left = [(x["doc_id"], x["text"]) for x in now.collect()]
    assert sum((t or "").count(same) for _, t in left) == 1 and (6, long) in left and {i for i, t in left if not (t or "").strip()} == {1, 2, 3}
    assert all(x["n_tokens"] >= 0 for x in out) and {x["doc_id"] for x in out} <= {i for i, _ in made}
