"""Approximate nearest neighbours by multi-index hashing of learned rotated binary codes.

A rotation learnt on a bounded sample (principal directions, then iterative quantisation) turns
vectors into codes of one bit a direction.  Codes are split into m substrings, each an index of its
own: a list of rows for every value.  If two codes are within r = m s + a bits, one of the first
a + 1 substrings is within s bits or one of the others within s - 1 (pigeonhole), so probing the
values that near retrieves every code in the radius.  Codes retrieved are compared whole, the
survivors are ranked again by exact cosine.  A query that finds too few is probed again with a
larger radius.

Every substring's index is dealt by value over tasks of bounded size, large buckets over several;
a query goes to the tasks that hold values it probes, and streams through them.  A pair
that several substrings retrieve is compared under the first of them alone.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, stored

#: Vectors the rotation and the radius are learnt on at most: those with the smallest hash of their id.
SAMPLE = 8_192
#: Sample queries that fix the radius, and the share of their true neighbours that it must hold.
PROBES, TARGET = 256, 0.97
#: Bits of a substring, and of a code at least.
SUBSTRING_BITS, LEAST_BITS = 16, 64
NEIGHBOURS = 5
#: Vectors that one task indexes at most, and ranges of substring values at most.
INDEX_BLOCK, RANGES = 16_384, 4_096
ROUNDS = 30


class Codes(NamedTuple):
    rotation: np.ndarray  # dimensions x bits
    radius: int

    @property
    def substrings(self) -> int:
        return self.rotation.shape[1] // SUBSTRING_BITS

    def near(self) -> list[int]:
        """Bits by which each substring may differ; below 0 it is not probed."""
        s, a = divmod(self.radius, self.substrings)
        return [s if j <= a else s - 1 for j in range(self.substrings)]

    def encode(self, unit: np.ndarray) -> np.ndarray:
        """Codes of unit vectors as 16-bit numbers, one substring each."""
        return np.packbits(unit @ self.rotation >= 0, axis=1).view(np.uint16)


def usable(vectors: DataFrame, vec_id: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, v): vectors that aren't null, empty or zero and hold no null, NaN or infinite component; floats stay floats."""
    kind = "float" if dict(vectors.dtypes)[column] == "array<float>" else "double"
    v = F.transform(column, lambda x: x.cast(kind))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return vectors.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).where(fine)


def unit_rows(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)  # no square overflows or vanishes
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def fit(sample: np.ndarray, k: int = NEIGHBOURS, target: float = TARGET) -> Codes:
    """Rotation by iterative quantisation; the radius that holds ``target`` of the sample's own k nearest pairs.

    In the whole table neighbours are nearer than in the sample, so the radius errs to the large side.
    """
    x = unit_rows(sample)
    n, d = x.shape
    bits = math.ceil(max(d, LEAST_BITS) / SUBSTRING_BITS) * SUBSTRING_BITS
    rng = np.random.default_rng(11)
    _, _, axes = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    axes = np.concatenate([axes, rng.standard_normal((max(0, bits - len(axes)), d))])[:bits].T
    flat = x @ axes
    turn, _ = np.linalg.qr(rng.standard_normal((bits, bits)))
    for _ in range(ROUNDS):
        u, _, w = np.linalg.svd(np.where(flat @ turn >= 0, 1.0, -1.0).T @ flat)
        turn = (u @ w).T
    codes = Codes(axes @ turn, bits)
    c = codes.encode(x)
    at = np.unique(np.linspace(0, n - 1, min(PROBES, n)).astype(int))
    score = x[at] @ x.T
    score[np.arange(len(at)), at] = -np.inf
    near = np.argsort(-score, axis=1)[:, : min(k, n - 1)]
    gaps = np.bitwise_count(c[at][:, None, :] ^ c[near]).sum(axis=2, dtype=np.int64).ravel()
    return codes._replace(radius=int(np.quantile(gaps, target, method="higher")) if gaps.size else bits)


#: Every 16-bit number, those with fewest bits first, and how many have k bits or fewer.
_BY_BITS = np.argsort(np.bitwise_count(np.arange(1 << SUBSTRING_BITS, dtype=np.uint16)), kind="stable").astype(np.uint16)
_UP_TO = np.cumsum([math.comb(SUBSTRING_BITS, k) for k in range(SUBSTRING_BITS + 1)])


def long_words(codes: np.ndarray) -> np.ndarray:
    """Codes as 64-bit words."""
    spare = -codes.shape[1] % 4
    return np.ascontiguousarray(np.pad(codes, ((0, 0), (0, spare)))).view(np.uint64)


class Index:
    """The bucket list of one substring over a block of codes."""

    def __init__(self, codes: np.ndarray, substring: int) -> None:
        self.codes, self.substring, self.words = codes, substring, long_words(codes)
        self.rows = np.argsort(codes[:, substring], kind="stable")
        self.values, self.starts, self.sizes = np.unique(codes[self.rows, substring], return_index=True, return_counts=True)

    def probe(self, value: np.uint16, near: int) -> np.ndarray:
        """Rows of the buckets whose value is within ``near`` bits: by looking up each such value, or, if there are fewer buckets, by going through these."""
        if near < 0:
            return self.rows[:0]
        ball = int(_UP_TO[min(near, SUBSTRING_BITS)])
        if ball < len(self.values):
            wanted = _BY_BITS[:ball] ^ value
            k = np.searchsorted(self.values, wanted)
            k = k[(k < len(self.values)) & (self.values[np.minimum(k, len(self.values) - 1)] == wanted)]
        else:
            k = np.flatnonzero(np.bitwise_count(self.values ^ value) <= near)
        sizes = self.sizes[k]
        return self.rows[np.arange(sizes.sum()) + np.repeat(self.starts[k] - np.cumsum(sizes) + sizes, sizes)]

    def within(self, code: np.ndarray, codes: Codes) -> tuple[np.ndarray, int]:
        """(rows within the radius that no earlier substring retrieves, codes compared)."""
        near = codes.near()
        found = self.probe(code[self.substring], near[self.substring])
        far = np.bitwise_count(self.words[found] ^ long_words(code[None, :]))
        hit = found[far.sum(axis=1, dtype=np.int64) <= codes.radius]
        for j in range(self.substring):
            hit = hit[np.bitwise_count(self.codes[hit, j] ^ code[j]).astype(np.int64) > near[j]]
        return hit, len(found)


def nearest(q_id: int, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> list[tuple[int, float]]:
    """(neighbour, cosine) of unit vectors: the k best, ties to smaller ids, the query's own id left out."""
    rough = x @ q
    rough[ids == q_id] = -np.inf
    low = np.partition(rough, len(rough) - k)[len(rough) - k] if len(rough) > k else -np.inf
    c = np.flatnonzero((rough >= low - 1e-9) & (rough > -np.inf))
    # once more pair by pair, so that equal vectors score the same wherever they stand
    exact = (q[None, :] * x[c]).sum(axis=1)
    return [(int(ids[c[t]]), float(exact[t])) for t in np.lexsort((ids[c], -exact))[:k]]


def one_each(vectors: DataFrame, dim: int) -> DataFrame:
    return vectors.where(F.size("v") == dim).groupBy("vec_id").agg(F.min("v").alias("v"))


def search(vectors: DataFrame, queries: DataFrame, k: int = NEIGHBOURS, sample: int = SAMPLE, target: float = TARGET, block: int = INDEX_BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of every query by cosine, nearest first.

    vectors: (vec_id, v) as ``usable`` gives them; queries: some of them, all rows of an id.  A
    query never finds its own id; of rows with one id that with the smallest vector counts; with
    fewer candidates there are fewer ranks.  Queries that find fewer than k within the learnt
    radius are searched again within a larger one, in the end among all codes.  Vectors of each
    length have codes of their own and meet those of their length alone; an id whose rows differ
    in length has one of each.
    """
    sizes = [r[0] for r in queries.select(F.size("v")).distinct().orderBy(F.size("v")).collect()]
    of = lambda rows, dim: rows.where(F.size("v") == dim)
    parts = [_search_length(of(vectors, n), of(queries, n), n, k, sample, target, block) for n in sizes]
    return functools.reduce(DataFrame.unionAll, parts) if parts else vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")


def _search_length(vectors: DataFrame, queries: DataFrame, dim: int, k: int, sample: int, target: float, block: int) -> DataFrame:
    chosen = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(sample).collect()
    if not chosen:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    codes = fit(np.array([r["v"] for r in chosen], np.float64), k, target)
    index, asked = (stored(coded(one_each(x, dim), codes), n) for x, n in ((vectors, "codes"), (queries, "queries")))
    full = min(k, index.count() - 1)
    shape = spread(index, codes, block)
    parts: list[DataFrame] = []
    while True:
        found = stored(_within(index, asked, codes, shape, k), "neighbours")
        if codes.radius >= codes.rotation.shape[1]:
            parts.append(found)
            break
        filled = found.groupBy("query_id").count().where(F.col("count") >= full).select(F.col("query_id").alias("filled_id"))
        parts.append(found.join(filled, F.col("query_id") == F.col("filled_id"), "left_semi"))
        asked = stored(asked.join(filled, F.col("vec_id") == F.col("filled_id"), "left_anti"), "short-queries")
        if asked.isEmpty():
            break
        codes = codes._replace(radius=min(2 * codes.radius + 8, codes.rotation.shape[1]))
    return functools.reduce(DataFrame.unionAll, parts)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, dim).astype(np.float64)


def coded(vectors: DataFrame, codes: Codes) -> DataFrame:
    """(vec_id, v, code): code as array of 16-bit numbers, one a substring."""
    dim, m = codes.rotation.shape[0], codes.substrings

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = codes.encode(unit_rows(matrix(batch.column(1), dim))).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(made) + 1, dtype=np.int32) * m), pa.array(made.ravel()))
        return pa.RecordBatch.from_arrays([*batch.columns, lists], names=["vec_id", "v", "code"])

    return map_arrow(vectors, run, f"vec_id long, v {dict(vectors.dtypes)['v']}, code array<int>")


class Spread(NamedTuple):
    """How each substring's values are dealt to tasks: by their leading bits, ranges of many rows over several tasks."""

    bits: int
    tasks: dict[tuple[int, int], int]  # of (substring, range), where it has more than one

    def of(self, j: int, part: int) -> int:
        return self.tasks.get((j, part), 1)


def spread(index: DataFrame, codes: Codes, block: int) -> Spread:
    bits = min(RANGES.bit_length() - 1, max(0, (index.count() - 1) // block).bit_length())
    part = F.shiftright(F.col("value"), SUBSTRING_BITS - bits)
    # at most substrings x RANGES rows
    rows = index.select(F.posexplode("code").alias("j", "value")).groupBy("j", part.alias("part")).count().where(F.col("count") > block).collect()
    return Spread(bits, {(r["j"], r["part"]): math.ceil(r["count"] / block) for r in rows})


def _task(j: int, part: int, n: int) -> int:
    return j << 48 | part << 32 | n


def _within(index: DataFrame, queries: DataFrame, codes: Codes, shape: Spread, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of every query among the codes within the radius."""
    dim, m, near = codes.rotation.shape[0], codes.substrings, codes.near()
    shift = SUBSTRING_BITS - shape.bits
    ranges = np.arange(1 << shape.bits)
    kind = f"task long, side int, vec_id long, v {dict(index.dtypes)['v']}, code array<int>"
    names = ["task", "side", "vec_id", "v", "code"]

    def dealt(batch: pa.RecordBatch, rows: list[int], tasks: list[int], side: int) -> pa.RecordBatch:
        picked = batch.take(pa.array(rows, pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(tasks, pa.int64()), pa.array(np.full(len(rows), side, np.int32)), *picked.columns], names=names)

    def deal_index(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, code, rows, tasks = batch.column(0).to_pylist(), batch.column(2).flatten().to_numpy().reshape(-1, m), [], []
        for j in range(m):
            rows += range(len(ids))
            tasks += [_task(j, p, (i * 0x9E3779B97F4A7C15 >> 40 & 0xFFFFFF) % shape.of(j, p)) for i, p in zip(ids, (code[:, j] >> shift).tolist(), strict=True)]
        return dealt(batch, rows, tasks, 0)

    def deal_queries(batch: pa.RecordBatch) -> pa.RecordBatch:
        code, rows, tasks = batch.column(2).flatten().to_numpy().reshape(-1, m), [], []
        for i in range(len(code)):
            for j in range(m):
                for p in np.flatnonzero(np.bitwise_count(ranges ^ (code[i, j] >> shift)) <= near[j]).tolist():
                    tasks += [_task(j, p, n) for n in range(shape.of(j, p))]
            rows += [i] * (len(tasks) - len(rows))
        return dealt(batch, rows, tasks, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, blocks, block = None, [], None
        for batch in batches:
            tasks, sides = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero((tasks[1:] != tasks[:-1]) | (sides[1:] != sides[:-1])) + 1).tolist(), batch.num_rows]
            found: list[tuple[int, int, float]] = []
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if tasks[a] != task:
                    task, blocks, block = int(tasks[a]), [], None
                if sides[a] == 0:
                    blocks.append((part.column(2).to_numpy(), part.column(3).flatten().to_numpy(), part.column(4).flatten().to_numpy()))
                    continue
                if block is None and blocks:
                    ids, flat, code = (np.concatenate(c) for c in zip(*blocks, strict=True))
                    blocks, block = [], (ids, unit_rows(flat.reshape(-1, dim).astype(np.float64)), Index(code.reshape(-1, m).astype(np.uint16), task >> 48))
                if block is None:
                    continue
                ids, unit, lists = block
                qs, q_codes = unit_rows(matrix(part.column(3), dim)), part.column(4).flatten().to_numpy().reshape(-1, m).astype(np.uint16)
                for q_id, q, q_code in zip(part.column(2).to_pylist(), qs, q_codes, strict=True):
                    hit, _ = lists.within(q_code, codes)
                    if len(hit):
                        found += [(q_id, i, c) for i, c in nearest(q_id, q, ids[hit], unit[hit], k)]
            if found:
                x, y, z = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(z, pa.float64())], names=["query_id", "vec_id", "score"])

    both = map_arrow(index, deal_index, kind).union(map_arrow(queries, deal_queries, kind))
    met = both.repartition("task").sortWithinPartitions("task", "side", "vec_id").mapInArrow(run, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
