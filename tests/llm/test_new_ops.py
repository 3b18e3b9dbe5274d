"""Source audit, vector codes and sentence pieces: brute force, the library itself, and odd rows."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from webstrata.llm import piece_rounds, source_audit, vector_codes
from webstrata.llm import queries as q

PIECES = public_tokenizers.path("piece_bpe_32k.model")


# Source audit


def brute_audit(rows, least):
    docs = [(lang or "", source or "", [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for lang, source, text in rows]
    out = []
    for lang in {x[0] for x in docs}:
        mine = [x for x in docs if x[0] == lang]
        df = Counter(t for _, _, terms in mine for t in set(terms))
        kept = [t for t, n in df.items() if n >= least]
        count = {s: Counter() for s in {x[1] for x in mine}}
        for _, s, terms in mine:
            count[s].update(t for t in terms if df[t] >= least)
        whole = sum(count.values(), Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}
        p, total = {s: share(c) for s, c in count.items()}, share(whole)
        for s in count:
            found = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in count if o != s]
            out += [(lang, s, "pair", o, v, k + 1) for k, (v, o) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode())))]
            found = [(p[s][t] - total[t], t) for t in kept if count[s][t] and p[s][t] > total[t]]
            out += [(lang, s, "term", t, v, k + 1) for k, (v, t) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:50])]
    return sorted(out)


def audit_rows(seed):
    r = random.Random(seed)
    words = ["Apple", "apple", "naïve", "Été", "été", "日本", "x", "UPPER", "it's", "a1b", "\x00nul\x00", "_under_", "é", "Straße", " nbsp ", *(f"w{chr(97 + k)}" for k in range(20))]
    rows = [(r.choice(["en", "fr", None, ""]), r.choice(["s1", "s2", "s10", None, "é", "z"]), " ".join(r.choices(words, k=r.randrange(30)))) for _ in range(160)]
    return [*rows, *rows[:9], ("en", "s1", None), ("xx", "only", ""), ("xx", "rare", "seldom"), ("yy", "alone", "x " * 40), ("en", "long", "apple pear\n" * 30_000)]


@pytest.mark.parametrize(("seed", "least", "bucket"), [(1, 3, 1 << 16), (2, 20, 4), (3, 10_000, 4)])
def test_audit_against_brute_force(spark, seed, least, bucket, monkeypatch):
    rows = audit_rows(seed)
    docs = spark.createDataFrame(rows, "lang string, source string, text string").withColumns({c: F.lit("clash") for c in ("term", "n", "docs", "bucket", "number", "total", "kept", "a", "b", "item", "doc_id")}).repartition(5)
    assert sorted(map(tuple, source_audit.source_audit(docs, least, bucket=bucket).collect())) == brute_audit(rows, least)


def test_audit_of_nothing(spark):
    got = source_audit.source_audit(spark.createDataFrame([], "lang string, source string, text string"))
    assert got.count() == 0 and got.columns == ["lang", "source", "part", "item", "value", "rank"]


def test_terms_do_not_depend_on_limits(monkeypatch):
    text = "One two, THREE—four\tfive " * 50
    whole = [t for part in source_audit.terms_of(text) for t in part]
    monkeypatch.setattr(source_audit, "CHUNK", 7)
    assert [t for part in source_audit.terms_of(text) for t in part] == whole and whole[:4] == [b"one", b"two", "three—four".encode(), b"five"]


def test_gallop_and_price():
    r = np.random.default_rng(4)
    for _ in range(200):
        a, b = (np.unique(r.integers(0, 300, r.integers(0, 90))) for _ in range(2))
        assert (source_audit.gallop(a, b) == np.searchsorted(b, a)).all()
    counts = r.integers(0, 10**13, 50)
    assert source_audit.price(counts, 9 * 10**15, 11).tolist() == [1 + 10**9 * (int(c) + 5) // (9 * 10**15 + 55) for c in counts]


# Vector codes


def brute_codes(rows):
    """rows: (vec_id, vector, label) of one length, a multiple of 16."""
    kept = sorted((r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = np.floor(256 * np.array([r[1] for r in kept])).astype(np.int64).reshape(len(kept), 16, -1)
    books = x[:64].copy()

    def assigned():
        d = ((x[:, None] - books[None]) ** 2).sum(axis=3)
        return d.argmin(axis=1), d.min(axis=1).sum(axis=1)

    for _ in range(2):
        entry, _ = assigned()
        for p in range(16):
            for e in range(len(books)):
                mine = x[entry[:, p] == e, p]
                if len(mine):
                    books[e, p] = mine.sum(axis=0) // len(mine)
    entry, error = assigned()
    name = hashlib.sha256(",".join(str(v) for p in range(16) for e in range(len(books)) for v in books[e, p]).encode()).hexdigest()
    sums = Counter()
    for r, e in zip(kept, error, strict=True):
        sums[r[2]] += int(e)
    return sorted((str(r[0]), "".join(f"{e:02x}" for e in en), int(er), sums[r[2]], name) for r, en, er in zip(kept, entry, error, strict=True))


@pytest.mark.parametrize(("n", "size", "spread"), [(300, 64, 0.3), (40, 16, 2.0), (200, 32, 0.01), (150, 48, 500.0)])
def test_codes_against_brute_force(spark, n, size, spread):
    r = random.Random(n)
    rows = [(k, [r.gauss(0, spread) for _ in range(size)], r.choice(["a", "b", None])) for k in r.sample(range(1000), n)]
    rows += [rows[5], rows[5], (rows[6][0], rows[7][1], "a"), (None, rows[8][1], "hot"), (None, [0.0] * size, "hot")]
    odd = [(5000, None, "a"), (5001, [None] * size, "a"), (5002, [float("nan"), *[0.0] * (size - 1)], "b"), (5003, [float("-inf"), *[0.0] * (size - 1)], None)]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label string").withColumns({c: F.lit(1) for c in ("code", "error", "v", "size", "part", "entry", "of_label", "place")}).repartition(4)
    got = sorted((str(x["vec_id"]), x["code"], x["error"], x["label_error"], x["codebooks_sha256"]) for x in vector_codes.vector_codes(table).collect())
    assert got == brute_codes(rows)


def test_vectors_of_each_length_have_their_own_codes(spark):
    r = random.Random(9)
    long, short = ([(k + base, [r.random() for _ in range(size)], 0) for k in range(70)] for base, size in ((0, 32), (100, 5)))
    table = spark.createDataFrame([*long, *short, (300, [], 0)], "vec_id long, embedding array<double>, label int")
    got = {x["vec_id"]: x for x in vector_codes.vector_codes(table).collect()}
    alone = brute_codes(long)
    filled = brute_codes([(i, v + [0.0] * 11, n) for i, v, n in short])
    assert {(str(i), got[i]["code"], got[i]["error"], got[i]["codebooks_sha256"]) for i in range(70)} == {(i, c, e, h) for i, c, e, _, h in alone}
    assert {(str(i), got[i]["code"], got[i]["error"], got[i]["codebooks_sha256"]) for i in range(100, 170)} == {(i, c, e, h) for i, c, e, _, h in filled}
    assert (got[300]["code"], got[300]["error"]) == ("00" * 16, 0) and got[300]["label_error"] == alone[0][3] + filled[0][3]


def test_codes_of_nothing_and_of_much(spark):
    kind = "vec_id long, embedding array<float>, label int"
    assert vector_codes.vector_codes(spark.createDataFrame([], kind)).count() == 0
    assert vector_codes.vector_codes(spark.createDataFrame([(1, None, 2)], kind)).count() == 0
    with pytest.raises(Exception, match="don't fit a long"):
        vector_codes.vector_codes(spark.createDataFrame([(1, [1e30] * 16, 2)], kind)).collect()


@pytest.mark.parametrize(("k", "m", "spread"), [(64, 4, 30), (64, 4, 2), (64, 1, 9), (1, 3, 5), (7, 48, 100)])
def test_boxes_find_the_nearest_entry(k, m, spread):
    r = np.random.default_rng(k * m)
    entries, x = r.integers(-spread, spread + 1, (k, m)), r.integers(-3 * spread, 3 * spread + 1, (500, m))
    d = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
    slices = vector_codes.Slices(entries)
    entry, far = slices.nearest(x)
    assert (entry == d.argmin(axis=1)).all() and (far == d.min(axis=1)).all()
    radius = r.integers(0, 2 * spread, len(x))
    box = (np.abs(x[:, None] - entries[None]) <= radius[:, None, None]).all(axis=2)
    assert [[e for e in range(k) if int(mask) >> e & 1] for mask in slices.inside(x, radius)] == [np.flatnonzero(b).tolist() for b in box]


# Sentence pieces

ALPHABET = ["a", "b", "e", "é", " ", "  ", "\n", "the", "!!", "1", "23", "'s", "ñ", "日本", "<s>", "</s>", "x" * 7, "\t", "▁", "▁▁", "Ωσ", "　", " ", "😀", "\x1c", "İ", "<0x41>", "<unk>", "A", "ing", " th", "er", "aaa", "\x00", "▁the", "\r\n", "​", "̈"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@pytest.mark.parametrize(("long", "section"), [(2048, 1 << 21), (3, 1 << 21), (6, 9)])
def test_rounds_are_the_plain_encoding(library, monkeypatch, long, section):
    monkeypatch.setattr(piece_rounds, "SECTION", section)
    e, r = piece_rounds.PieceEncoder(PIECES, long=long), random.Random(long)
    texts = ["".join(r.choices(r.sample(ALPHABET, r.randrange(1, len(ALPHABET))), k=r.randrange(150))) for _ in range(400)]
    texts += ["".join(r.choices("etaoinshrdlu", k=r.randrange(400))) for _ in range(150)] + ["", " ", "   ", "▁"]
    for text, got in zip(texts, e.encode(texts), strict=True):
        want = library.encode(text, add_bos=True, add_eos=True)
        assert np.frombuffer(got, "<u4").tolist() == want, text
        assert e.decode(got) == library.decode(want)


@pytest.mark.parametrize("text", ["a" * 30_000, " " * 9_000, "日本" * 20_000, "ab" * 9_000 + "c", "word " * 40_000])
def test_long_words(library, text):
    assert np.frombuffer(piece_rounds.encoder_of(PIECES).encode([text])[0], "<u4").tolist() == library.encode(text, add_bos=True, add_eos=True)


def test_decode_of_any_ids(library):
    e, r = piece_rounds.encoder_of(PIECES), random.Random(5)
    for _ in range(600):
        ids = [r.randrange(32_000) if r.random() < 0.5 else r.randrange(260) for _ in range(r.randrange(10))]
        assert e.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids)


def test_piece_query(spark, library):
    rows = [(0, None), (1, ""), (2, "twice here"), (2, "twice here"), (None, "no id"), (8, "word " * 50_000), (7, "\n \n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("n_tokens", "ids", "ids_sha256")})
    want = []
    for i, text in rows:
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        want.append((str(i), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    got = piece_rounds.piece_digests(docs, with_ids=True).collect()
    assert sorted((str(x["doc_id"]), *tuple(x)[1:4]) for x in got) == sorted(want)
    assert all(x["n_tokens"] == len(x["ids"]) and x["ids"][0] == 1 and x["ids"][-1] == 2 for x in got)
    assert piece_rounds.piece_digests(docs.limit(0)).count() == 0


def test_piece_query_on_documents(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {x["doc_id"]: x["ids_sha256"] for x in q.QUERIES["op13_piece_rounds"](spark, sf_dir).collect()}
    texts = docs.select("doc_id", "text").collect()
    assert len(got) == len(texts)
    for x in texts:
        assert got[x["doc_id"]] == hashlib.sha256(np.array(library.encode(x["text"], add_bos=True, add_eos=True), "<u4").tobytes()).hexdigest()
