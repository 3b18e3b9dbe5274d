"""The whole pipeline against a plain chain of its five stages, each written out without the operators."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from webstrata.llm import line_crf

from .test_text_ops import DOCS, brute_classes, brute_passages

WORDS = "river garden window letter morning bread village harbour winter paper carried walked under over quiet bright again never small always while before after their house road the a of and to was in with for".split()


def prose(r, lines):
    sentence = lambda: " ".join(r.choice(WORDS) for _ in range(r.randrange(8, 16))).capitalize() + "."
    return "\n".join(" ".join(sentence() for _ in range(r.randrange(1, 4))) for _ in range(lines))


def junk(r, lines):
    return "\n".join(" ".join(r.choice(["$$$", "CLICK", "!!!", "#1", "|", "WIN", "%%", ">>>"]) for _ in range(r.randrange(2, 9))) for _ in range(lines))


def rows(r):
    """Prose of three sources (one holds most), copies, near copies, passages that documents share, one that holds nothing else, junk, odd texts."""
    shared = [prose(r, 12) for _ in range(2)]
    texts = [prose(r, r.randrange(4, 14)) for _ in range(24)]
    texts += [texts[3], texts[3], texts[3] + "\nOne more line.", texts[5]]
    texts += [f"{prose(r, 3)}\n{s}\n{prose(r, 2)}" for s in shared for _ in range(3)] + [shared[0]]
    texts += [junk(r, r.randrange(3, 9)) for _ in range(12)]
    texts += [None, "", prose(r, 400)]
    ids = r.sample(range(1000), len(texts))
    return [(i, t, "en", (None if k % 11 == 0 else "b" if k % 5 == 0 else "a"), len(t or "")) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]


def score(crf, text):
    """Length-weighted share of good lines, by forward and backward sums of one text, line by line."""
    feats, _, length = line_crf.line_features([text])
    n = len(feats)
    bins = [[int(np.searchsorted(crf.edges[f], x, side="right")) for f, x in enumerate(line)] for line in feats]
    none = [line_crf.BINS] * feats.shape[1]
    emit = []
    for k in range(n):
        near = (bins[k - 1] if k else none, bins[k], bins[k + 1] if k + 1 < n else none)
        emit.append(crf.bias + sum(crf.weights[p][f][b] for p, line in enumerate(near) for f, b in enumerate(line)))
    add = lambda xs: max(xs) + math.log(sum(math.exp(x - max(xs)) for x in xs))
    own = lambda k, y: emit[k] if y else 0.0
    fwd, bwd = [[own(0, 0), own(0, 1)]], [[0.0, 0.0]]
    for k in range(1, n):
        fwd.append([own(k, y) + add([fwd[-1][x] + crf.moves[x][y] for x in (0, 1)]) for y in (0, 1)])
    for k in range(n - 1, 0, -1):
        bwd.insert(0, [add([crf.moves[x][y] + own(k, y) + bwd[0][y] for y in (0, 1)]) for x in (0, 1)])
    good = [math.exp(f[1] + b[1] - add([f[0] + b[0], f[1] + b[1]])) for f, b in zip(fwd, bwd, strict=True)]
    return sum(g * (w + 1) for g, w in zip(good, length, strict=True)) / sum(w + 1 for w in length)


def repeats(docs):
    """How often each document comes: the least k whose Poisson sum reaches its hashed number, in steps of a rate of at most 16."""
    chars: dict = {}
    for _, t, _, s, _ in docs:
        chars[s] = chars.get(s, 0) + len(t or "")
    chars = {s: n for s, n in chars.items() if n}
    roots, total = sum(math.sqrt(n) for n in chars.values()), sum(chars.values())
    out = []
    for i, _, _, s, _ in docs:
        rate = math.sqrt(chars[s]) / roots * total / chars[s] if s in chars else 0.0
        steps, n = math.ceil(rate / 16), 0
        for step in range(1, steps + 1):
            u = (int(hashlib.md5(f"mix:{i}:{step}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            k, p = 0, math.exp(-rate / steps)
            reach = p
            while reach < u:
                k += 1
                p *= rate / steps / k
                reach += p
            n += k
        out.append(n)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_pipeline_against_a_plain_chain(spark, tmp_path, seed):
    import corpus_pipeline as p

    made = rows(random.Random(seed))
    frame = spark.createDataFrame(made, DOCS)
    frame.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, int("!!!" not in t and "$$$" not in t), 0) for k, (i, t, *_) in enumerate(made) if t and k % 3], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")

    crf = line_crf.learn(frame, labels)
    kept = [d for d in made if score(crf, d[1] or "") >= line_crf.ACCEPT]
    assert 30 < len(kept) < len(made) - 8
    classes = brute_classes([(i, t) for i, t, *_ in kept])
    kept = [d for d in kept if str(d[0]) in {c for i, c, _ in classes if i == str(d[0])}]
    assert len(kept) <= len(classes) - 3
    cuts = brute_passages([(i, t) for i, t, *_ in kept])
    left = [(i, t if i not in cuts else "".join(c for c, gone in zip(t, cuts[i], strict=True) if not gone), g, s, n) for i, t, g, s, n in kept]
    left = [d for d in left if d[0] not in cuts or d[1].split()]
    assert sum(d[1] != k[1] for d in left for k in kept if d[0] == k[0]) >= 3
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for (i, t, *_), n in zip(left, repeats(left), strict=True):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        text = tokenizer.decode(ids, skip_special_tokens=False)
        want += [(i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())] * n
    assert sorted(map(tuple, p.run(spark, str(tmp_path)).collect())) == sorted(want)
