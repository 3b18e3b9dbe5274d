"""Vector compression by product codes of integer components; the nearest entry is found by slice-and-intersect bitmasks.

A codebook has at most 64 entries, so a set of entries is one unsigned 64-bit number.  For each
dimension the entries' coordinates are sorted, with the mask of the entries before each place: the
entries within a range of coordinates are the difference of two such masks, and those inside a box
are the ranges' masks ANDed over the dimensions.  The box of an initial radius gives candidates,
which are measured exactly.  A candidate no farther than the radius is the nearest entry, as all
entries that near lie in the box; otherwise the radius grows, to the distance of the best candidate
where there is one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import few, stored

#: Parts of a vector, entries of a codebook, rounds of learning, and units of a component.
PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256


class Slices:
    """The entries of one codebook, sorted in each dimension."""

    def __init__(self, entries: np.ndarray) -> None:
        if not 0 < len(entries) <= ENTRIES:
            raise ValueError(f"{len(entries)} entries")
        self.entries = entries
        order = np.argsort(entries, axis=0, kind="stable")
        self.sorted = np.take_along_axis(entries, order, axis=0)
        self.before = np.zeros((len(entries) + 1, entries.shape[1]), np.uint64)
        self.before[1:] = np.bitwise_or.accumulate(np.uint64(1) << order.astype(np.uint64), axis=0)
        apart = ((entries[:, None] - entries[None]) ** 2).sum(axis=2)
        np.fill_diagonal(apart, np.iinfo(np.int64).max)
        # the usual distance of an entry to the next one
        self.radius = max(1, int(np.sqrt(np.median(apart.min(axis=1))))) if len(entries) > 1 else 1

    def inside(self, x: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Masks of the entries in the boxes of the given radii around the rows of x."""
        mask = np.full(len(x), ~np.uint64(0) >> np.uint64(ENTRIES - len(self.entries)))
        for d in range(x.shape[1]):
            low = np.searchsorted(self.sorted[:, d], x[:, d] - radius, "left")
            high = np.searchsorted(self.sorted[:, d], x[:, d] + radius, "right")
            mask &= self.before[high, d] ^ self.before[low, d]
        return mask

    def best_of(self, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of the nearest entry in each mask, ties to the lower entry; -1 without one."""
        entry, least = np.full(len(x), -1), np.full(len(x), np.iinfo(np.int64).max)
        rows = np.flatnonzero(mask)
        mask = mask[rows]
        while len(rows):
            lowest = mask & (~mask + np.uint64(1))
            e = np.bitwise_count(lowest - np.uint64(1)).astype(np.int64)
            far = ((x[rows] - self.entries[e]) ** 2).sum(axis=1)
            nearer = far < least[rows]
            entry[rows[nearer]], least[rows[nearer]] = e[nearer], far[nearer]
            mask ^= lowest
            rows, mask = rows[mask != 0], mask[mask != 0]
        return entry, least

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of the nearest entry to each row of x."""
        entry, least = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        rows, radius = np.arange(len(x)), np.full(len(x), self.radius, np.int64)
        while len(rows):
            e, far = self.best_of(x[rows], self.inside(x[rows], radius))
            sure = (e >= 0) & (far <= radius * radius)
            entry[rows[sure]], least[rows[sure]] = e[sure], far[sure]
            wider = np.where(e >= 0, np.sqrt(far.astype(np.float64)).astype(np.int64) + 1, 2 * radius)
            rows, radius = rows[~sure], wider[~sure]
        return entry, least


def units(vectors: pa.Array, size: int) -> np.ndarray:
    """(row, part, position): floors of the scaled components; vectors whose length isn't a multiple of the parts get zeros behind."""
    x = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size) * SCALE)
    # a distance stays within 62 bits
    if x.size and np.abs(x).max() >= 2**30 / max(1, size) ** 0.5:
        raise ValueError(f"a component beyond {2**30 / size**0.5 / SCALE:.0f}: squared distances don't fit a long")
    wide = -(-size // PARTS)
    out = np.zeros((len(x), PARTS * wide), np.int64)
    out[:, :size] = x
    return out.reshape(-1, PARTS, wide)


Books = dict[int, np.ndarray]  # by vector length: (part, entry, position)


def by_length(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, np.ndarray, pa.RecordBatch]]:
    """(length, units, rows) of the vectors of each length."""
    sizes = batch.column(column).value_lengths().to_numpy()
    for size in np.unique(sizes).tolist():
        rows = batch.filter(pa.array(sizes == size))
        yield size, units(rows.column(column), size) if size else np.zeros((rows.num_rows, PARTS, 0), np.int64), rows


def assign(x: np.ndarray, slices: list[Slices]) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each row and part."""
    made = [s.nearest(x[:, p]) for p, s in enumerate(slices)]
    return np.stack([m[0] for m in made], axis=1), np.stack([m[1] for m in made], axis=1)


def kept(vectors: DataFrame, column: str) -> DataFrame:
    v = F.col(column)
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(v.isNotNull() & ~odd).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), v.cast("array<double>").alias("v"))


def first_books(rows: DataFrame) -> Books:
    """The parts of the vectors with the smallest ids of each length; 64 rows a length reach the driver."""
    w = Window.partitionBy(F.size("v")).orderBy(F.asc_nulls_last("vec_id"), "v")
    first = rows.select("vec_id", "v").withColumn("place", F.row_number().over(w)).where(F.col("place") <= ENTRIES).orderBy("place").collect()
    sizes = sorted({len(r["v"]) for r in first})
    return {n: units(pa.array([r["v"] for r in first if len(r["v"]) == n], pa.list_(pa.float64())), n).transpose(1, 0, 2) if n else np.zeros((PARTS, sum(not r["v"] for r in first), 0), np.int64) for n in sizes}


def moved(rows: DataFrame, books: Books) -> Books:
    """Each entry replaced by the floored mean of the parts that are nearest to it; sums are exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = {n: [Slices(b) for b in book] for n, book in books.items()}
        sums = {n: np.zeros((*book.shape[:2], book.shape[2] + 1), np.int64) for n, book in books.items()}
        for batch in batches:
            for n, x, _ in by_length(batch, 0):
                entry, _ = assign(x, slices[n])
                for p in range(PARTS):
                    np.add.at(sums[n][p], entry[:, p], np.concatenate([np.ones((len(x), 1), np.int64), x[:, p]], axis=1))
        for n, s in sums.items():
            p, e, d = (a.ravel() for a in np.indices(s.shape, dtype=np.int32))
            cols = [np.full(s.size, n, np.int32), p, e, d, s.ravel()]
            used = np.repeat(s[:, :, :1] > 0, s.shape[2], axis=2).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(c[used]) for c in cols], names=["size", "part", "entry", "position", "total"])

    made = rows.select("v").mapInArrow(run, "size int, part int, entry int, position int, total long")
    # at most parts x entries x positions rows a length; totals as decimals, so that none overflows
    totals = made.groupBy("size", "part", "entry", "position").agg(F.sum(F.col("total").cast("decimal(20,0)")).alias("total")).collect()
    sums = {n: np.zeros((*book.shape[:2], book.shape[2] + 1), object) for n, book in books.items()}
    for r in totals:
        sums[r["size"]][r["part"], r["entry"], r["position"]] = int(r["total"])
    out = {}
    for n, book in books.items():
        count, total = sums[n][:, :, :1], sums[n][:, :, 1:]
        out[n] = np.where(count > 0, total // np.maximum(count, 1), book).astype(np.int64)
    return out


def digest(book: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def coder(books: Books) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(vec_id, label, v) to (vec_id, label, code, error, codebooks_sha256)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = {n: [Slices(b) for b in book] for n, book in books.items()}
        names = {n: digest(book) for n, book in books.items()}
        for batch in batches:
            for n, x, rows in by_length(batch, 2):
                entry, far = assign(x, slices[n])
                code = entry.astype(np.uint8).tobytes().hex()
                codes = [code[k : k + 2 * PARTS] for k in range(0, len(code), 2 * PARTS)]
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(codes, pa.string()), pa.array(far.sum(axis=1)), pa.array([names[n]] * len(x), pa.string())], names=["vec_id", "label", "code", "error", "codebooks_sha256"])

    return run


def learn(rows: DataFrame, rounds: int = ROUNDS) -> Books:
    books = first_books(rows)
    for _ in range(rounds):
        books = moved(rows, books)
    return books


def vector_codes(vectors: DataFrame, column: str = "embedding", rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every vector without null or non-finite components.

    Rows are independent, so repeated ids and null ids (the largest where the first codebooks are
    chosen; equal ids by their vectors) give rows of their own; other columns are ignored.  Vectors
    of each length have codebooks of their own; a length that isn't a multiple of the parts counts
    as filled up with zeros, an empty vector has code 0 and error 0.  With fewer than 64 vectors the
    codebooks have as many entries.  Components whose squared distances leave the range of a long
    raise an error.  An empty table gives no rows.
    """
    rows = kept(vectors, column)
    books = learn(rows, rounds)
    kind = dict(rows.dtypes)["label"]
    schema = f"vec_id long, label {kind}, code string, error long, codebooks_sha256 string"
    coded = stored(rows.mapInArrow(coder(books), schema), "vector-codes")
    sums = few(stored(coded.groupBy(F.col("label").alias("of_label")).agg(F.sum("error").alias("label_error")), "label-errors"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of_label"))).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


_ASSIGN = """a{k} as (select vec_id, p, min(s * 64 + e) k from (select c.vec_id, c.p, b.e, cast(sum((c.x - b.x) * (c.x - b.x)) as bigint) s from c join e{k} b on b.p = c.p and b.d = c.d group by c.vec_id, c.p, b.e) group by vec_id, p)"""
_MOVE = """e{j} as (select b.p, b.e, b.d, coalesce(n.x, b.x) x from e{k} b left join (
    select p, e, d, (s - ((s % n + n) % n)) // n x from (select c.p, a.k % 64 e, c.d, cast(sum(c.x) as bigint) s, count(*) n from c join a{k} a on a.vec_id = c.vec_id and a.p = c.p group by c.p, a.k % 64, c.d)
    ) n on n.p = b.p and n.e = b.e and n.d = b.d)"""
#: For vectors of one length, a multiple of the parts, under ids of their own.
ORACLE = (
    """with kept as (select vec_id, label, embedding v, row_number() over (order by vec_id) - 1 k from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
    c as (select vec_id, i // (len(v) // 16) p, i % (len(v) // 16) d, cast(floor(256 * cast(v[i + 1] as double)) as bigint) x from kept, unnest(range(0, len(v))) t(i)),
    e0 as (select c.p, kept.k e, c.d, c.x from c join kept on kept.vec_id = c.vec_id where kept.k < 64), """
    + ", ".join(x.format(j=k + 1, k=k) for k in range(ROUNDS) for x in (_ASSIGN, _MOVE))
    + ", " + _ASSIGN.format(k=ROUNDS)
    + f""", coded as (select vec_id, string_agg(printf('%02x', cast(k % 64 as integer)), '' order by p) code, cast(sum(k // 64) as bigint) error from a{ROUNDS} group by vec_id),
    labels_of as (select kept.label, cast(sum(error) as bigint) label_error from coded join kept on kept.vec_id = coded.vec_id group by kept.label)
    select coded.vec_id, code, error, label_error, (select sha256(string_agg(cast(x as varchar), ',' order by p, e, d)) from e{ROUNDS}) codebooks_sha256
    from coded join kept on kept.vec_id = coded.vec_id join labels_of on labels_of.label is not distinct from kept.label"""
)
