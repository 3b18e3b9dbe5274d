"""Near-duplicate join: MinHash banding on word n-grams, every candidate verified on full sets.

Texts with equal n-gram sets form one class, so copies cost one row each.  Classes that share a
band hash are candidates.  To verify them without listing pairs, each class gets a home (the
smallest class of its fullest bucket), homes are dealt into blocks of bounded numbers of classes and
n-grams, and every pair
of blocks that meet in some bucket is one task that compares their full sets.  A block pair is
one task however many bands it shares, so each link is counted once.  Tasks give link counts and a
spanning forest, never pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_bytes, map_arrow, stored, text_column
from .components import components
from .words import grams, mix, words

#: Words of an n-gram, and the least Jaccard similarity of a link.
NGRAM = 5
THRESHOLD = 0.8
#: Probability that a pair at the threshold shares a band.
RECALL = 0.9998
#: Most hash functions to spend.
HASHES = 128
#: Stands for a null id in join keys.
NO_ID = -(2**63)
#: White space as Python's split() takes it, for a Java character class.
SPACES = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Classes of a block, and n-grams of a block (8 bytes each), at most on average.
BLOCK, BLOCK_GRAMS = 256, 1 << 20
#: Blocks of one bucket that meet in one join key, on average.
CHUNK = 64


def band_plan(threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows a band whose number of bands for the recall fits the hash functions."""
    best = (hashes, 1)
    for rows in range(1, hashes + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows <= hashes:
            best = (bands, rows)
    return best


def text_sets(texts: list[str], n: int = NGRAM) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text; a text of 1 to n - 1 words has one n-gram of them all."""
    w = words(texts)
    all_grams = grams(w.hashes, n)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(all_grams[a : b - n + 1]))
        else:
            out.append(grams(w.hashes[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


def set_key(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


class Signer:
    """Band hashes of sets; the hash functions derive from fixed seeds."""

    def __init__(self, bands: int, rows: int) -> None:
        seeds = mix(np.arange(1, 2 * bands * rows + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))
        self.mul = (seeds[: bands * rows] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        self.add = (seeds[bands * rows :] >> np.uint64(32)).astype(np.uint32)
        self.bands, self.rows = bands, rows

    def sign(self, sets: list[np.ndarray]) -> np.ndarray:
        """(sets, bands) 64-bit hashes; no set may be empty."""
        flat = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
        at = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
        low = np.empty((len(self.mul), len(sets)), np.uint64)
        work = np.empty_like(flat)
        for i, (m, a) in enumerate(zip(self.mul, self.add, strict=True)):
            np.multiply(flat, m, out=work)
            work += a
            work ^= work >> np.uint32(15)
            work *= np.uint32(0x2C1B3C6D)
            low[i] = np.minimum.reduceat(work, at)
        out = np.zeros((len(sets), self.bands), np.uint64)
        for b in range(self.bands):
            h = np.full(len(sets), np.uint64(b + 1))
            for r in range(self.rows):
                h = mix(h * np.uint64(0x9E3779B97F4A7C15) + low[b * self.rows + r] + np.uint64(1))
            out[:, b] = h
        return out


def signed(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, text_hash, cid (class: digest of the n-gram set, null without words), bands, size (of the set)."""
    signer = Signer(bands, rows)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, keys, hashes, sizes = batch.column(2).to_pylist(), [], [], []
        for a, b in by_bytes(texts, 1 << 20):
            sets = text_sets(texts[a:b], n)
            keys += map(set_key, sets)
            sizes += map(len, sets)
            full = [s for s in sets if len(s)]
            rows_of = iter(signer.sign(full).view(np.int64) if full else [])
            hashes += [next(rows_of) if len(s) else None for s in sets]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(hashes, pa.list_(pa.int64())), pa.array(sizes, pa.int64())], names=["doc_id", "text_hash", "cid", "bands", "size"]
        )

    return map_arrow(keyed(docs), run, "doc_id long, text_hash long, cid binary, bands array<long>, size long")


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_column()).alias("text_hash"), text_column().alias("text"))


def verify(a: list[np.ndarray], b: list[np.ndarray] | None, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs with Jaccard similarity at the threshold: inside a, or between a and b."""
    own = b is None
    left, right = a, a if own else b
    flat = np.concatenate([*left, *([] if own else right)])
    values, code, df = np.unique(flat, return_inverse=True, return_counts=True)
    shared = df > 1
    column = np.cumsum(shared) - 1
    n_left, size = sum(map(len, left)), int(shared.sum())
    row = np.repeat(np.arange(len(left)), [len(s) for s in left])
    code_l = code[:n_left]
    both = np.zeros((len(left), len(right)), np.float32)
    if own:
        row_r, code_r = row, code_l
    else:
        row_r, code_r = np.repeat(np.arange(len(right)), [len(s) for s in right]), code[n_left:]
    step = max(1, (1 << 24) // max(len(left), len(right)))
    for lo in range(0, size, step):
        mats = []
        for r, c, k in ((row, code_l, len(left)), (row_r, code_r, len(right))):
            ok = shared[c] & (column[c] >= lo) & (column[c] < lo + step)
            m = np.zeros((k, min(step, size - lo)), np.float32)
            m[r[ok], column[c][ok] - lo] = 1
            mats.append(m)
            if own:
                mats.append(m)
                break
        both += mats[0] @ mats[1].T
    na, nb = (np.array([len(s) for s in x], np.float32) for x in (left, right))
    hit = both >= np.float32(threshold) * (na[:, None] + nb[None, :] - both) - 1e-3
    x, y = np.nonzero(hit)
    if own:
        x, y = x[x < y], y[x < y]
    # exact in integers-as-doubles where single precision was too coarse to decide
    inter = both[x, y].astype(np.float64)
    ok = inter >= threshold * (na[x].astype(np.float64) + nb[y] - inter) - 1e-9
    yield x[ok], y[ok]


def verify_tasks(rows: DataFrame, threshold: float) -> DataFrame:
    """rows(task, side, cid, copies, grams) dealt and sorted by task to (cid, links, root): a class's links and its forest's smallest class."""

    def finish(group: list[tuple[int, bytes, int, np.ndarray]]) -> Iterator[tuple[bytes, int, bytes]]:
        a = [g for g in group if g[0] == 0]
        b = [g for g in group if g[0] == 1]
        every = a + b
        links, parent = [0] * len(every), list(range(len(every)))

        def top(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        if len(every) < 2 or (b and not a):
            return
        for x, y in verify([g[3] for g in a], [g[3] for g in b] if b else None, threshold):
            for i, j in zip(x.tolist(), (y + (len(a) if b else 0)).tolist()):
                links[i] += every[j][2]
                links[j] += every[i][2]
                p, q = top(i), top(j)
                if p != q:
                    if every[p][1] > every[q][1]:
                        p, q = q, p
                    parent[q] = p
        for i, g in enumerate(every):
            if links[i]:
                yield g[1], links[i], every[top(i)][1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, group, done = None, [], []

        def out() -> pa.RecordBatch:
            k, n, r = zip(*done, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(k, pa.binary()), pa.array(n, pa.int64()), pa.array(r, pa.binary())], names=["cid", "links", "root"])

        for batch in batches:
            for t, side, cid, copies, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if t != task:
                    done += finish(group)
                    task, group = t, []
                group.append((side, cid, copies, np.frombuffer(data, "<u8")))
            if len(done) > 10_000:
                yield out()
                done = []
        done += finish(group)
        if done:
            yield out()

    dealt = rows.repartition("task").sortWithinPartitions("task", "side", "cid").select("task", "side", "cid", "copies", "grams")
    return dealt.mapInArrow(run, "cid binary, links long, root binary")


def block_pairs(spots: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(block, other), block <= other, each once, of blocks that meet in a bucket of spots(bucket, block), a block with itself included.

    A bucket's blocks are dealt into chunks, and every pair of chunks is a join key of its own, so
    a bucket of very many blocks spreads over many tasks.
    """
    n = spots.groupBy(F.col("bucket").alias("of")).agg(F.ceil(F.count(F.lit(1)) / F.lit(chunk)).cast("int").alias("n"))
    dealt = spots.join(n, F.col("bucket") == F.col("of")).withColumn("c", F.pmod(F.xxhash64("block"), F.col("n")).cast("int"))
    left = dealt.select("bucket", "block", F.col("c").alias("a"), F.explode(F.sequence("c", F.col("n") - 1)).alias("b"))
    right = dealt.select("bucket", F.col("block").alias("other"), F.explode(F.sequence(F.lit(0), "c")).alias("a"), F.col("c").alias("b"))
    met = left.join(right, ["bucket", "a", "b"]).where("a < b or block <= other")
    return met.select(F.least("block", "other").alias("block"), F.greatest("block", "other").alias("other")).distinct()


def near_duplicates(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES, block: int = BLOCK) -> DataFrame:
    """One row a document: doc_id, text_hash, class_key (of its class, null without words), class_id (smallest doc_id of its class), n_links.

    A link joins two rows whose n-gram sets have Jaccard similarity >= threshold (rows with equal
    sets included); classes are the connected components; n_links counts the other rows a row is
    linked to.  Null and empty texts, and texts of white space, are never linked: class_id is their
    own doc_id.  A null doc_id stays null and gives no class id unless its whole class has none;
    repeated rows are copies of each other.
    """
    bands, rows = band_plan(threshold, recall, hashes)
    signed_docs = stored(signed(docs, n, bands, rows), "signed")
    classes = stored(
        signed_docs.where("cid is not null")
        .groupBy("cid")
        .agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc_id", "text_hash")).alias("rep"), F.min("doc_id").alias("first_id"), F.first("bands").alias("bands"), F.min("size").alias("size")),
        "classes",
    )
    hits = classes.select(F.explode("bands").alias("bucket"), "cid")
    shared = hits.groupBy("bucket").agg(F.min("cid").alias("leader"), F.count(F.lit(1)).alias("members")).where("members > 1")
    met = stored(hits.join(shared, "bucket"), "buckets")
    home = met.groupBy("cid").agg(F.max(F.struct("members", "leader"))["leader"].alias("home"))
    home = home.join(classes.select(F.col("cid").alias("sized"), "size"), F.col("cid") == F.col("sized"))
    needed = F.ceil(F.greatest(F.count(F.lit(1)) / F.lit(block), F.sum("size") / F.lit(BLOCK_GRAMS)))
    blocks = home.join(home.groupBy(F.col("home").alias("h")).agg(needed.alias("n_blocks")), F.col("home") == F.col("h"))
    placed = stored(blocks.select("cid", F.xxhash64("home", F.pmod(F.xxhash64("cid"), F.col("n_blocks"))).alias("block")), "blocks")
    spots = met.select("bucket", "cid").join(placed, "cid").select("bucket", "block").distinct()
    pairs = block_pairs(spots)
    tasks = pairs.withColumn("task", F.xxhash64("block", "other"))
    parts = tasks.select("task", "block", F.lit(0).alias("side")).union(tasks.where("block <> other").select("task", F.col("other").alias("block"), F.lit(1).alias("side")))
    members = placed.join(classes.select("cid", "copies", "rep"), "cid")
    texts = keyed(docs).join(
        members.select("cid", "block", "copies", F.col("rep.doc_id").alias("rep_id"), F.col("rep.text_hash").alias("rep_hash")),
        F.col("doc_id").eqNullSafe(F.col("rep_id")) & (F.col("text_hash") == F.col("rep_hash")),
    )

    def sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        t = batch.column(3).to_pylist()
        for a, b in by_bytes(t, 1 << 20):
            out += [s.astype("<u8").tobytes() for s in text_sets(t[a:b], n)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(out, pa.binary())], names=["cid", "block", "copies", "grams"])

    # rows that repeat a representative's id and text give the same class again
    full = map_arrow(texts.select("cid", "block", "copies", "text").dropDuplicates(["cid"]), sets, "cid binary, block long, copies long, grams binary")
    found = stored(verify_tasks(full.join(parts, "block"), threshold), "links")
    roots = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    rooted = classes.select("cid", "copies", "first_id").join(links, "cid", "left").join(roots, F.col("cid") == F.col("node"), "left").withColumn("root", F.coalesce("root", "cid"))
    firsts = rooted.groupBy(F.col("root").alias("r")).agg(F.min("first_id").alias("class_id"))
    by_class = rooted.join(firsts, F.col("root") == F.col("r")).select(
        F.col("cid").alias("of_cid"), "class_id", F.col("r").alias("class_key"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    return signed_docs.select("doc_id", "text_hash", "cid").join(by_class, F.col("cid") == F.col("of_cid"), "left").select(
        "doc_id", "text_hash", "class_key", F.when(F.col("cid").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")
    )


def drop_near_duplicates(docs: DataFrame, **options: float) -> DataFrame:
    """One row of each near-duplicate class, that with the smallest doc_id (nulls last); texts without words all stay.  Columns unchanged."""
    found = near_duplicates(docs, **options)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    first = found.where("class_key is not null").groupBy("class_key").agg(F.min(order).alias("k"))
    first = first.select(F.coalesce("k.doc_id", F.lit(NO_ID)).alias("k_id"), F.col("k.text_hash").alias("k_hash"))
    marked = docs.select(F.struct(*docs.columns).alias("nd_row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("nd_id"), F.xxhash64(text_column()).alias("nd_hash"))
    wordless = ~F.coalesce(F.col("nd_row.text"), F.lit("")).rlike(f"[^{SPACES}]")
    joined = marked.join(first, (F.col("nd_id") == F.col("k_id")) & (F.col("nd_hash") == F.col("k_hash")), "left")
    nth = F.row_number().over(Window.partitionBy("nd_id", "nd_hash").orderBy("nd_hash"))
    return joined.withColumn("nd_nth", nth).where(wordless | (F.col("k_id").isNotNull() & (F.col("nd_nth") == 1))).select("nd_row.*")
