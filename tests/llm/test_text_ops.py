"""Quality, near duplicates, passages and the pipeline's filters against brute force, with odd rows."""

from __future__ import annotations

import collections
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from webstrata.llm import components, line_crf, ngram_join, suffix_dedup, words

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", None if t is None else len(t)) for i, t in rows], DOCS)


def vocabulary(r, n, size=400):
    return " ".join(f"w{r.randrange(size)}" for _ in range(n))


def odd_rows(r):
    base = vocabulary(r, 120).split(" ")
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "one two"), (4, "one  two"), (5, "é　ü ñ 日本 😀"), (6, "x " * 20_000)]
    for i in range(10, 40):
        t = list(base)
        for _ in range(r.randrange(5)):
            t[r.randrange(len(t))] = "edit"
        rows.append((i, " ".join(t)))
    rows += [(50, rows[12][1]), (51, rows[12][1]), (51, rows[12][1]), (None, rows[12][1]), (None, vocabulary(r, 60)), (None, None), (7, vocabulary(r, 300))]
    return rows + [(60 + i, vocabulary(r, r.randrange(3, 90))) for i in range(20)]


def shingles(t):
    w = (t or "").split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_classes(rows, threshold=0.8):
    sets, parent, links = [shingles(t) for _, t in rows], list(range(len(rows))), [0] * len(rows)

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                parent[top(a)] = top(b)
    members = collections.defaultdict(list)
    for i in range(len(rows)):
        members[top(i)].append(rows[i][0])
    least = lambda ids: min((x for x in ids if x is not None), default=None)
    return sorted((str(rows[i][0]), str(least(members[top(i)]) if sets[i] else rows[i][0]), links[i]) for i in range(len(rows)))


def test_near_duplicates(spark):
    rows = odd_rows(random.Random(1))
    for block in (256, 4):
        got = ngram_join.near_duplicates(docs_of(spark, rows), block=block).collect()
        assert sorted((str(r["doc_id"]), str(r["class_id"]), r["n_links"]) for r in got) == brute_classes(rows)


def test_near_duplicates_of_nothing(spark):
    assert ngram_join.near_duplicates(docs_of(spark, [])).count() == 0
    assert ngram_join.drop_near_duplicates(docs_of(spark, [])).count() == 0


def test_drop_near_duplicates_keeps_one_of_each_group(spark):
    rows = odd_rows(random.Random(2))
    clash = docs_of(spark, rows).withColumns({c: F.lit(1) for c in ("cid", "bands", "nd_id", "nd_row", "k_id", "class_key")})
    kept = ngram_join.drop_near_duplicates(clash)
    assert kept.columns == clash.columns
    got = sorted(str((r["doc_id"], r["text"])) for r in kept.collect())
    expect, seen = [], set()
    sets = [shingles(t) for _, t in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                parent[top(a)] = top(b)
    for i in order:
        if not sets[i] or top(i) not in seen:
            seen.add(top(i))
            expect.append(str(rows[i]))
    assert got == sorted(expect)


def test_band_plan_reaches_its_recall():
    for recall in (0.9, 0.99, 0.9998):
        b, r = ngram_join.band_plan(0.8, recall, 128)
        assert 1 - (1 - 0.8**r) ** b >= recall and b * r <= 128


def test_verify_against_sets():
    r = np.random.default_rng(3)
    sets = [np.unique(r.integers(0, 60, r.integers(1, 50)).astype(np.uint64)) for _ in range(60)]
    want = lambda x, y: {(i, j) for i, a in enumerate(x) for j, b in enumerate(y) if len(np.intersect1d(a, b)) >= 0.5 * len(np.union1d(a, b)) - 1e-9}
    (x, y) = next(ngram_join.verify(sets, None, 0.5))
    assert set(zip(x.tolist(), y.tolist(), strict=True)) == {(i, j) for i, j in want(sets, sets) if i < j}
    (x, y) = next(ngram_join.verify(sets[:20], sets[20:], 0.5))
    assert set(zip(x.tolist(), y.tolist(), strict=True)) == want(sets[:20], sets[20:])


@pytest.mark.parametrize("chunk", [1, 3, 64])
def test_block_pairs(spark, chunk):
    r = random.Random(31)
    spots = {(b, r.randrange(40)) for b in range(12) for _ in range(r.choice([1, 2, 30]))}
    want = {(min(x, y), max(x, y)) for a, x in spots for b, y in spots if a == b}
    got = [tuple(x) for x in ngram_join.block_pairs(spark.createDataFrame(list(spots), "bucket long, block long"), chunk).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_passages_on_the_documents_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = {x["doc_id"] for x in suffix_dedup.repeated_passages(docs).collect()}
    assert found == set(brute_passages([(x["doc_id"], x["text"]) for x in docs.select("doc_id", "text").collect()]))


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)] + [(500, None)]
    got = {x["node"]: x["root"] for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def top(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in edges:
        if b is not None and a != b:
            x, y = sorted((top(a), top(b)))
            parent[y] = x
    assert got == {i: top(i) for i in parent}


def test_words_are_split_as_python_does():
    r = random.Random(5)
    for _ in range(200):
        texts = ["".join(r.choice("ab \n\té　\x1c\x85😀") for _ in range(r.randrange(20))) for _ in range(r.randrange(5))]
        w = words.words(texts)
        for k, t in enumerate(texts):
            raw = t.encode()
            assert [raw[a:b].decode() for a, b in zip(w.starts[w.first[k] : w.first[k + 1]], w.ends[w.first[k] : w.first[k + 1]], strict=True)] == t.split()
    a, b = words.words(["x y z", "z y  x"]), words.words(["", "q z y x"])
    assert a.hashes[2] == b.hashes[1] and a.hashes[0] == b.hashes[3]
    assert words.grams(a.hashes, 2)[3] == words.grams(b.hashes, 2)[1]


def brute_passages(rows, size=50):
    windows, found = collections.defaultdict(set), {}
    spots = {i: [(m.start(), m.end(), m.group()) for m in re.finditer(r"\S+", t or "")] for i, t in rows}
    for i, s in spots.items():
        for k in range(len(s) - size + 1):
            windows[tuple(x[2] for x in s[k : k + size])].add(i)
    for i, t in rows:
        s, cut = spots[i], [False] * len(t or "")
        hit = False
        for k in range(len(s) - size + 1):
            holders = windows[tuple(x[2] for x in s[k : k + size])]
            hit |= len(holders) > 1
            if min(holders) < i:
                cut[s[k][0] : s[k + size - 1][1]] = [True] * (s[k + size - 1][1] - s[k][0])
        if hit:
            found[i] = cut
    return found


def passage_rows(r):
    parts = [" ".join(r.choice("abcdefghij") for _ in range(n)) for n in (49, 50, 51, 60, 80, 130)]
    rows = []
    for i in range(70):
        text = "\n ".join(r.choice(parts) if r.random() < 0.5 else vocabulary(r, r.randrange(30)) for _ in range(r.randrange(5)))
        rows.append((i, text + " é" * (i % 3)))
    return rows + [(100, None), (101, ""), (102, rows[3][1]), (103, "x " * 300), (104, "x " * 90), (105, vocabulary(r, 3000))]


def test_passages(spark):
    rows = passage_rows(random.Random(6))
    want, text = brute_passages(rows), dict(rows)
    got = {r["doc_id"]: r["spans"] for r in suffix_dedup.repeated_passages(docs_of(spark, rows)).collect()}
    assert set(got) == set(want)
    for i, spans in got.items():
        cut = [False] * len(text[i])
        for s in spans:
            if s["removed"]:
                end = len(text[i]) if s["end"] < 0 else s["end"]
                cut[s["start"] : end] = [True] * (end - s["start"])
        assert [c for c, x in zip(cut, text[i], strict=True) if not x.isspace()] == [c for c, x in zip(want[i], text[i], strict=True) if not x.isspace()]


def brute_first_docs(rows, size=50):
    """Smallest holder of every window that several texts hold, as {doc_id: {(first_doc, start, end)}} with windows of one holder joined."""
    spots = {i: [(m.start(), m.end(), m.group()) for m in re.finditer(r"\S+", t or "")] for i, t in rows}
    holders, found = collections.defaultdict(set), {}
    for i, s in spots.items():
        for k in range(len(s) - size + 1):
            holders[tuple(x[2] for x in s[k : k + size])].add(i)
    for i, s in spots.items():
        joined = collections.defaultdict(list)
        for k in range(len(s) - size + 1):
            who, a, b = holders[tuple(x[2] for x in s[k : k + size])], s[k][0], s[k + size - 1][1]
            if len(who) > 1:
                mine = joined[min(who)]
                if mine and a <= mine[-1][1]:
                    mine[-1][1] = b
                else:
                    mine.append([a, b])
        if joined:
            found[i] = {(f, a, b) for f, spans in joined.items() for a, b in spans}
    return found


def test_passages_name_every_first_document(spark):
    r = random.Random(12)
    popular, longer = vocabulary(r, 60, 9_000), vocabulary(r, 200, 9_000)
    rows = [(3, popular), (5, popular + " " + longer), (10, popular + " " + longer + " end"), (11, longer + " " + popular)]
    parts = [vocabulary(r, n) for n in (50, 55, 70, 90)]
    for i in range(20, 60):
        # every text of its own: copies are one whole span
        rows.append((i, " ".join(r.choice(parts) if r.random() < 0.7 else vocabulary(r, 5) for _ in range(4)) + f" only{i}"))
    docs = docs_of(spark, rows)
    got = {x["doc_id"]: {(s["first_doc"], s["start"], s["end"]) for s in x["spans"]} for x in suffix_dedup.repeated_passages(docs).collect()}
    assert got == brute_first_docs(rows)
    assert {f for f, _, _ in got[10]} == {3, 5}


@pytest.mark.parametrize("ids", [(-1, None), (None, None), (5, 5)])
def test_odd_ids_keep_a_passage_once(spark, ids):
    r = random.Random(21)
    passage, tails = vocabulary(r, 60, 9_000), [vocabulary(r, 55, 9_000) for _ in ids]
    rows = [(i, f"{passage} {t}") for i, t in zip(ids, tails, strict=True)]
    docs = docs_of(spark, rows)
    found = suffix_dedup.repeated_passages(docs).collect()
    assert len(found) == 2 and sorted(s["removed"] for x in found for s in x["spans"]) == [False, True]
    first = min(ids, key=lambda i: (i is None, i or 0))
    assert {s["first_doc"] for x in found for s in x["spans"]} == {first}
    out = [(x["doc_id"], x["text"]) for x in suffix_dedup.cut_passages(docs).collect()]
    assert len(out) == 2 and sum(t.count(passage) for _, t in out) == 1 and all(any(t.endswith(x) for _, t in out) for x in tails)
    if ids[0] != ids[1]:
        assert next(t for i, t in out if i == first).startswith(passage)


@pytest.mark.parametrize("partitions", [12])
def test_runs_across_partitions(spark, partitions, monkeypatch):
    """Many partitions, so that runs of the sorted order cross their edges, and words that only differ far on."""
    r = random.Random(22)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        long = ["k" * 70 + str(i) for i in range(3)]
        hot = vocabulary(r, 75, 9_000)
        rows = []
        for i in range(90):
            a, b = r.randrange(0, 20), r.randrange(56, 76)
            rows.append((i, " ".join([vocabulary(r, r.randrange(9)), " ".join(hot.split()[a:b]), r.choice(long), vocabulary(r, 3)])))
        rows += [(200 + i, " ".join(r.choice(long) for _ in range(200)) + f" end{i}") for i in range(3)]
        got = {x["doc_id"]: {(s["first_doc"], s["start"], s["end"]) for s in x["spans"]} for x in suffix_dedup.repeated_passages(docs_of(spark, rows)).collect()}
        assert got == brute_first_docs(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_common_words():
    r = random.Random(23)
    for _ in range(500):
        a, b = ([r.choice(["a", "ab", "é", "b"]) for _ in range(r.randrange(8))] for _ in range(2))
        b = a[: r.randrange(9)] + b
        n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert suffix_dedup.common_words("".join(x + " " for x in a), "".join(x + " " for x in b)) == n


def test_cut_passages(spark):
    rows = passage_rows(random.Random(7)) + [(200, None), (200, None), (201, "short")]
    twice = (300, vocabulary(random.Random(8), 70))
    docs = docs_of(spark, [*rows, twice, twice, (None, twice[1])]).withColumns({c: F.lit(2) for c in ("cuts", "low", "cid", "cut_hash", "a_id", "pos")})
    kept = suffix_dedup.cut_passages(docs)
    assert kept.columns == docs.columns
    out = [(r["doc_id"], r["text"], r["n_chars"]) for r in kept.collect()]
    assert sum(i == 300 for i, _, _ in out) == 1 and (201, "short", 5) in out and sum(i == 200 for i, _, _ in out) == 2
    want = brute_passages(rows)
    clean = {i: t for i, t in rows if i not in want}
    got = {i: t for i, t, _ in out}
    assert all(got[i] == t for i, t in clean.items())
    for i, t in rows:
        if i in want:
            left = "".join(c for c, gone in zip(t, want[i], strict=True) if not gone)
            assert got.get(i, "").split() == left.split()
    assert all(n == len(t) for _, t, n in out if t is not None)


def test_passages_of_nothing(spark):
    assert suffix_dedup.repeated_passages(docs_of(spark, [])).count() == 0
    assert suffix_dedup.cut_passages(docs_of(spark, [])).count() == 0


def test_marginals_against_enumeration():
    r = np.random.default_rng(1)
    crf = line_crf.LineCrf(np.zeros((1, line_crf.BINS - 1)))
    crf.moves = r.normal(size=(2, 2))
    first = np.array([0, 4, 5, 8])
    emit = r.normal(size=8)
    p, moved = crf.marginals(emit, first)
    want, pairs = np.zeros(8), np.zeros((2, 2))
    for a, b in zip(first[:-1], first[1:], strict=True):
        n, total, mine, mp = b - a, 0.0, np.zeros(b - a), np.zeros((2, 2))
        for code in range(1 << n):
            y = [code >> i & 1 for i in range(n)]
            w = np.exp(sum(emit[a + i] * y[i] for i in range(n)) + sum(crf.moves[y[i - 1], y[i]] for i in range(1, n)))
            total += w
            mine += w * np.array(y)
            for i in range(1, n):
                mp[y[i - 1], y[i]] += w
        want[a:b] = mine / total
        pairs += mp / total
    assert np.allclose(p, want) and np.allclose(moved, pairs)


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scored = {r["doc_id"]: r for r in line_crf.quality(docs, labels).collect()}
    assert len(scored) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for i, r in scored.items())
    held = [(scored[r["doc_id"]]["score"], r["quality"]) for r in labels.collect() if scored[r["doc_id"]]["held_out"]]
    good, bad = [s for s, q in held if q == 1], [s for s, q in held if q == 0]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.97 and np.mean([(s >= 0.3) == q for s, q in held]) > 0.95


def test_quality_ignores_everything_but_text(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    crf = line_crf.learn(docs, labels)
    odd = spark.createDataFrame([(None, None), (1, ""), (2, "\n\n"), (3, "a"), (3, "a"), (4, "word " * 50_000), (5, "line\n" * 3000)], "doc_id long, text string")
    got = line_crf.score_lines(odd, crf).collect()
    assert len(got) == 7 and all(0 <= r["score"] <= 1 for r in got)
    flipped = labels.withColumn("quality", F.when(line_crf.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    other = line_crf.learn(docs.withColumns({c: F.lit(None).cast("string") for c in ("lang", "source")}), flipped)
    assert np.array_equal(crf.weights, other.weights) and np.array_equal(crf.moves, other.moves)
    torn = labels.union(labels.limit(20).withColumn("quality", 1 - F.col("quality")))
    ids = [r["doc_id"] for r in labels.limit(20).collect()]
    without = line_crf.learn(docs, labels.where(~F.col("doc_id").isin(ids)))
    assert np.array_equal(line_crf.learn(docs, torn.union(torn)).weights, without.weights)
    assert np.array_equal(line_crf.learn(docs.repartition(5), labels).weights, crf.weights)
    none = line_crf.quality(odd, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    kept = line_crf.keep_good(docs.withColumn("score", F.lit("mine")).withColumn("row", F.lit(1)), labels)
    assert kept.columns == [*docs.columns, "score", "row"] and 0 < kept.count() < docs.count() and {r["score"] for r in kept.collect()} == {"mine"}


def test_learning_takes_whole_documents(spark, monkeypatch):
    rows = [(i, "\n".join(f"A line of words {k}." for k in range(300)) if i % 2 else "\n".join("%% $$ ##" for _ in range(i % 7 + 1))) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    seen = []
    fit = line_crf.LineCrf.fit
    monkeypatch.setattr(line_crf.LineCrf, "fit", lambda self, near, first, good: seen.append((near.shape[1], first, good)) or fit(self, near, first, good, steps=2))
    line_crf.learn(docs_of(spark, rows), labels)
    ids = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5]
    n, first, good = seen.pop()
    assert n == sum(300 if i % 2 else i % 7 + 1 for i in ids) == len(good) and np.diff(first).max() == 64
    line_crf.learn(docs_of(spark, rows), labels, sample=10)
    assert 0 < seen.pop()[0] <= 3_000
    line_crf.learn(docs_of(spark, rows), labels, lines=2_000)
    n, _, good = seen.pop()
    assert 600 < n <= 2_000 and set(good) == {0.0, 1.0}
    line_crf.learn(docs_of(spark, rows), labels, longest=20)
    assert set(seen.pop()[2]) == {0.0}


@pytest.mark.parametrize("rows", [[], [(1, None)], [(None, "a b c d e f")]])
def test_small_tables(spark, rows):
    assert ngram_join.near_duplicates(docs_of(spark, rows)).count() == len(rows)
    assert suffix_dedup.cut_passages(docs_of(spark, rows)).count() == len(rows)
