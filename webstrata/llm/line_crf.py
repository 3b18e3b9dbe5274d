"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad.  Its score sums weights looked up by the binned features of itself and
its two neighbours; a transition matrix ties neighbouring labels.  Forward-backward gives each
line's probability of being good, and the document's quality is their mean, weighted by length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, map_arrow, stored, text_column

#: Labelled documents learnt from, whole, in the order of their ids' hashes: this many and lines of this number in
#: all at most (48 bytes a line on the driver), and lines of one document.
SAMPLE_DOCS, SAMPLE_LINES, SAMPLE_LONGEST = 6_000, 500_000, 5_000
#: Lines of a training sequence; longer documents are several sequences.
SEGMENT = 64
BINS = 8
STEPS = 120
#: Documents below this score are rejected.
ACCEPT = 0.3

FEATURES = ("length", "upper", "symbols", "digits", "word_length", "shouts", "symbol_ends", "stops", "repeats", "marks", "alone", "twins")

_rng = np.random.default_rng(7)
#: A number for each byte; their sum tells words apart, whatever the order of letters.
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64)
_class = {}
for _name, _chars in {
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": "abcdefghijklmnopqrstuvwxyz",
    "digit": "0123456789",
    "space": " \t\r\x0b\x0c",
    "plain": ".,;:'\"()-?",
    "stop": ".?:",
}.items():
    _class[_name] = np.zeros(256, bool)
    _class[_name][[ord(c) for c in _chars]] = True
_class["high"] = np.arange(256) >= 0xC0
_class["tail"] = (np.arange(256) >= 0x80) & (np.arange(256) < 0xC0)
_class["symbol"] = ~(_class["upper"] | _class["lower"] | _class["digit"] | _class["space"] | _class["plain"] | _class["high"] | _class["tail"])
_class["symbol"][10] = False


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of every line, first line of each text and the number of lines, line lengths in bytes).

    Lines part at newlines; a text has one at least, an empty one if it's empty.
    """
    raw = [t.encode("utf-8", "surrogatepass") + b"\n" for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    first = np.concatenate([[0], np.searchsorted(ends, np.cumsum(sizes) - 1) + 1])

    def per_line(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return (total[ends] - total[starts]).astype(np.float64)

    kind = {k: v[data] for k, v in _class.items()}
    gap = kind["space"] | (data == 10)
    word_end = ~gap[:-1] & gap[1:]
    n_words = np.maximum(per_line(np.concatenate([word_end, [False]])), 1)
    length = (ends - starts).astype(np.float64)
    some = np.maximum(length, 1)
    letters = per_line(kind["upper"]) + per_line(kind["lower"]) + per_line(kind["high"])
    # a line's hash, to see lines that their document has had before
    power = np.cumsum(np.ones(len(data), np.uint64) * np.uint64(0x9E3779B97F4A7C15)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(data)]]))).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    power ^= power >> np.uint64(29)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(7)) * power)])
    owner = np.repeat(np.arange(len(texts)), np.diff(first))
    key = (total[ends] - total[starts]) ^ (owner.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    _, at, inverse, times = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    repeats = np.where(length > 0, np.minimum(times[inverse] - 1, 3), 0)
    last = data[np.maximum(ends - 1, 0)]
    before = np.concatenate([[True], gap[:-1]])
    after = np.concatenate([gap[1:], [True]])
    begin, stop = np.flatnonzero(before & ~gap), np.flatnonzero(after & ~gap) + 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data])])
    sums = sums[stop] - sums[begin]
    line = np.searchsorted(ends, begin)
    twin = np.flatnonzero((sums[1:] == sums[:-1]) & (line[1:] == line[:-1]))
    twins = np.bincount(line[twin], minlength=len(ends)).astype(np.float64)
    feats = np.stack(
        [
            np.log1p(length),
            per_line(kind["upper"]) / np.maximum(letters, 1),
            per_line(kind["symbol"]) / some,
            per_line(kind["digit"]) / some,
            (length - per_line(kind["space"])) / n_words,
            per_line(data == 33) / n_words,
            per_line(np.concatenate([word_end & kind["symbol"][:-1], [False]])) / n_words,
            per_line(kind["stop"]) / n_words,
            repeats,
            (_class["stop"][last] & (length > 0)).astype(np.float64),
            per_line(before & after & kind["symbol"]) / n_words,
            twins / n_words,
        ],
        axis=1,
        dtype=np.float32,
    )
    return feats, first, length


class LineCrf:
    """weights[position, feature, bin]: previous, own, next line; bin BINS where there's no such line."""

    def __init__(self, edges: np.ndarray) -> None:
        self.edges = edges
        self.weights = np.zeros((3, edges.shape[0], BINS + 1))
        self.bias, self.moves = 0.0, np.zeros((2, 2))

    def bins(self, feats: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(self.edges[f], feats[:, f], side="right") for f in range(feats.shape[1])], axis=1)

    def near(self, bins: np.ndarray, first: np.ndarray) -> np.ndarray:
        """(3, lines, features): bins of the line before, the line, the line after, inside one text."""
        none = np.full((1, bins.shape[1]), BINS)
        before, after = np.concatenate([none, bins[:-1]]), np.concatenate([bins[1:], none])
        before[first[:-1]] = BINS
        after[first[1:] - 1] = BINS
        return np.stack([before, bins, after])

    def emit(self, near: np.ndarray) -> np.ndarray:
        f = np.arange(near.shape[2])
        return self.bias + sum(self.weights[p][f, near[p]].sum(axis=1) for p in range(3))

    def marginals(self, emit: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(good) of each line, and the expected transition counts, by scaled forward-backward over all texts at once."""
        n = np.diff(first)
        order = np.argsort(-n, kind="stable")
        active = np.searchsorted(-n[order], -np.arange(1, n.max(initial=0) + 1), side="right")  # texts with more than t lines
        start = first[:-1][order]
        m = np.exp(self.moves - self.moves.max())
        top = np.maximum(emit, 0)
        e = np.stack([np.exp(-top), np.exp(emit - top)], axis=1)
        fwd, bwd = np.empty_like(e), np.ones_like(e)
        for t, k in enumerate(active.tolist()):
            at = start[:k] + t
            a = e[at] if t == 0 else (fwd[at - 1] @ m) * e[at]
            fwd[at] = a / a.sum(axis=1, keepdims=True)
        moved = np.zeros((2, 2))
        for t in range(len(active) - 1, 0, -1):
            at = start[: active[t]] + t
            eb = e[at] * bwd[at]
            b = eb @ m.T
            bwd[at - 1] = b / b.sum(axis=1, keepdims=True)
            pair = fwd[at - 1][:, :, None] * m[None] * eb[:, None, :]
            moved += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        p = fwd * bwd
        return p[:, 1] / p.sum(axis=1), moved

    def fit(self, near: np.ndarray, first: np.ndarray, good: np.ndarray, steps: int = STEPS, rate: float = 0.15, l2: float = 1e-4) -> None:
        """Maximise the mean conditional log likelihood (Adam); first: bounds of the sequences; good: the label of each line."""
        n, width, f = near.shape[1], BINS + 1, np.arange(near.shape[2])
        same = np.ones(n, bool)
        same[first[:-1]] = False
        y = good.astype(int)
        seen = np.zeros((2, 2))
        at = np.flatnonzero(same)
        np.add.at(seen, (y[at - 1], y[at]), 1)
        cells = (f[None] * width + near).reshape(3, n, -1)
        state = [np.zeros(self.weights.size + 5) for _ in range(2)]
        for k in range(1, steps + 1):
            p, moved = self.marginals(self.emit(near), first)
            gap = (good - p) / n
            g = [np.bincount(cells[q].ravel(), np.repeat(gap, len(f)), minlength=len(f) * width) for q in range(3)]
            grad = np.concatenate([*g, [gap.sum()], ((seen - moved) / n).ravel()])
            now = np.concatenate([self.weights.ravel(), [self.bias], self.moves.ravel()])
            grad -= l2 * now
            state[0] = 0.9 * state[0] + 0.1 * grad
            state[1] = 0.99 * state[1] + 0.01 * grad**2
            now += rate * (state[0] / (1 - 0.9**k)) / (np.sqrt(state[1] / (1 - 0.99**k)) + 1e-8)
            self.weights, self.bias, self.moves = now[:-5].reshape(self.weights.shape), float(now[-5]), now[-4:].reshape(2, 2)

    def scores(self, texts: list[str]) -> np.ndarray:
        """Length-weighted mean probability of good lines; every line counts its bytes and one more."""
        feats, first, length = line_features(texts)
        p, _ = self.marginals(self.emit(self.near(self.bins(feats), first)), first)
        weight = length + 1
        return np.clip(np.add.reduceat(p * weight, first[:-1]) / np.add.reduceat(weight, first[:-1]), 0, 1)


def held_out() -> "F.Column":
    """True where crc32 of the id's text is a multiple of 5, and for null ids: never learnt from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCS, lines: int = SAMPLE_LINES, longest: int = SAMPLE_LONGEST) -> LineCrf:
    """Fit on every line of a bounded sample of labelled documents that aren't held out; a line's label is its document's.

    A doc_id whose label rows disagree is not learnt from; rows of docs that repeat a doc_id are
    documents of their own.  A document of more than ``longest`` lines doesn't teach, so that no one
    fills the sample, and one that no longer fits into ``lines`` is passed over for shorter ones
    behind it; both are scored as any other.  With no usable label the model is empty: every score is 0.5.
    """
    rows = labels.where(F.col("quality").isin(0, 1) & ~held_out()).groupBy(F.col("doc_id").alias("l_id")).agg(F.min("quality").alias("low"), F.max("quality").cast("double").alias("good")).where("low = good")
    chosen = rows.orderBy(F.xxhash64("l_id"), "l_id").limit(sample)
    texts = docs.select("doc_id", text_column().alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("l_id")).select(F.xxhash64("l_id").alias("pick"), F.xxhash64("text").alias("pick_text"), "good", "text")

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [line_features([t])[0] for t in batch.column(3).to_pylist()]
        cols = [*batch.columns[:3], pa.array([len(f) for f in found], pa.int64()), pa.array([f.tobytes() for f in found], pa.binary())]
        return pa.RecordBatch.from_arrays(cols, names=["pick", "pick_text", "good", "n_lines", "feats"])

    measured = map_arrow(texts, measure, "pick long, pick_text long, good double, n_lines long, feats binary").where(F.col("n_lines") <= longest)
    measured = stored(measured.withColumn("row_no", F.monotonically_increasing_id()), "line-features")
    budget = {}
    for r in measured.orderBy("pick", "pick_text", "row_no").select("row_no", "n_lines").limit(sample).collect():
        if r["n_lines"] <= lines:
            lines -= r["n_lines"]
            budget[r["row_no"]] = r["n_lines"]
    got = sorted(measured.where(F.col("row_no").isin(list(budget))).select("good", "feats").collect(), key=lambda r: (r["good"], bytes(r["feats"]))) if budget else []
    if not got:
        return LineCrf(np.zeros((len(FEATURES), BINS - 1)))
    blocks = [np.frombuffer(r["feats"], np.float32).reshape(-1, len(FEATURES)) for r in got]
    feats, sizes = np.concatenate(blocks), np.array([len(b) for b in blocks])
    crf = LineCrf(np.quantile(feats, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T.astype(np.float32))
    first = np.concatenate([[0], np.cumsum(sizes)])
    cuts = np.concatenate([np.arange(a, b, SEGMENT) for a, b in zip(first, first[1:])] + [first[-1:]])
    crf.fit(crf.near(crf.bins(feats), first), cuts, np.repeat([r["good"] for r in got], sizes))
    return crf


def score_lines(docs: DataFrame, crf: LineCrf) -> DataFrame:
    """(doc_id, score, row): ``row`` holds every column of docs; null and empty texts are one empty line."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).to_pylist()
        score = np.concatenate([crf.scores(texts[a:b]) for a, b in by_bytes(texts, 1 << 20)])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), *batch.columns[2:]], names=["doc_id", "score", *batch.schema.names[2:]])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text"), *([F.struct(*docs.columns).alias("row")] if len(docs.columns) > 2 else []))
    kind = dict(chosen.dtypes).get("row")
    return map_arrow(chosen, run, "doc_id long, score double" + (f", row {kind}" if kind else ""))


def quality(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs; with no usable labels every score is 0.5."""
    return score_lines(docs.select("doc_id", "text"), learn(docs, labels)).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= accept).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """Rows of docs that score at least ``accept``, columns unchanged."""
    padded = docs if len(docs.columns) > 2 else docs.withColumn("crf_pad", F.lit(0))
    return score_lines(padded, learn(docs, labels)).where(F.col("score") >= accept).select(*(F.col(f"row.`{c}`") for c in docs.columns))
