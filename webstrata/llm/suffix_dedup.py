"""Repeated passages across documents by sparse suffix arrays.

Suffixes are retained only where the hash of their first words is the least of a window, so any two
equal passages retain the same suffixes.  A hash of those first words drops suffixes that no other
text can share (equal words always have equal hashes, so none is lost).  The rest are sorted
twice over range partitions, by the words that follow and, inside one prefix, by the words before in
reverse order; each is compared with its neighbours in the sorted order word by word.  Suffixes
with d common words are one run of that order, so the first position of the run names those d words
exactly.  A passage is then a suffix, a length to the left and one to the right: the two runs
that extend it.  Whole texts are told apart by SHA-256; no other hash decides about equality.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from .common import by_bytes, map_arrow, stored, text_column
from .ngram_join import SPACES
from .words import grams, words

#: Words of the shortest passage that counts, and of the prefix whose hash selects suffixes.
PASSAGE = 50
PREFIX = 25
#: Longer words stand in sort keys by their SHA-256.
WORD_CHARS = 64
#: Bits of a row's number inside its partition, and a number of common words beyond any.
PART_BITS, UNKNOWN = 40, 1 << 30
SPANS = "array<struct<start: bigint, end: bigint, first_doc: bigint, removed: boolean>>"


def _least(v: np.ndarray, w: int) -> np.ndarray:
    """Index of the leftmost least value of every window of w."""
    at, size = np.arange(len(v)), 1
    while size < w:
        s = min(size, w - size)
        left = v[:-s] <= v[s:] if s < len(v) else np.zeros(0, bool)
        v, at = np.where(left, v[: len(left)], v[len(v) - len(left) :]), np.where(left, at[: len(left)], at[len(at) - len(left) :])
        size += s
    return at


def runs(texts: list[str], passage: int = PASSAGE, prefix: int = PREFIX) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text; text, prefix hash, word, least and greatest offset of its windows for each retained suffix).

    A window is a passage's place: it starts ``offset`` words before the suffix that it chose.
    """
    w = words(texts)
    n_words = np.diff(w.first)
    g = grams(w.hashes, prefix)
    at = _least(g, passage - prefix + 1)
    owner = np.repeat(np.arange(len(texts)), n_words)
    ok = np.flatnonzero(owner[: len(at)] == owner[passage - 1 : passage - 1 + len(at)])
    p = at[ok]
    if not len(p):
        e = np.zeros(0, np.int64)
        return n_words, e, e, e, e, e
    new = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (ok[1:] != ok[:-1] + 1)]))
    lo, hi, m = ok[new], ok[np.concatenate([new[1:], [len(ok)]]) - 1], p[new]
    t = owner[lo]
    return n_words, t, g[m].view(np.int64), m - w.first[t], m - hi, m - lo


def char_offsets(text: str, at: np.ndarray) -> np.ndarray:
    """Character offsets of byte offsets into the text's UTF-8."""
    if text.isascii():
        return at
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    return np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[at]


def merge(pos: np.ndarray) -> list[tuple[int, int]]:
    """Union of the intervals packed as start << 32 | end."""
    out: list[list[int]] = []
    for x in np.unique(pos).tolist():
        a, b = x >> 32, x & 0xFFFFFFFF
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def common_words(a: str, b: str) -> int:
    """Leading words that two keys share; every word of a key ends with a space."""
    if a == b:
        return a.count(" ")
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a.startswith(b[lo:mid], lo):
            lo = mid
        else:
            hi = mid - 1
    return a.count(" ", 0, lo)


def text_keys() -> list[Column]:
    """128 bits of a text's SHA-256, which tell texts apart, as two numbers."""
    digest = F.sha2(F.encode(text_column(), "UTF-8"), 256)
    return [F.conv(F.substring(digest, at, 16), 16, -10).cast("long").alias(c) for c, at in (("c1", 1), ("c2", 17))]


def sorted_runs(rows: DataFrame, base: int, depths: int, name: str) -> DataFrame:
    """Rows (g, key, ...) in sorted order with ``starts`` and ``reach``, stored; ``key`` and ``g`` go.

    starts[d]: position of the first row whose g and first base + d words of the key are those of
    this row, an exact name of those words.  reach: words in common with the nearer of its two neighbours,
    or more where a neighbour lies in another partition.  Keys are range-partitioned (with every
    other column, so that equal keys spread too); runs that cross partitions get one name
    by two rows a partition, its first and its last.
    """
    others = [c for c in rows.columns if c not in ("g", "key")]
    order = ["g", "key", "ord", "near", "far"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        at = part << PART_BITS
        before: tuple[int, str] | None = None
        starts: list[int] = []
        held: tuple[pa.RecordBatch, list[int], list[int]] | None = None

        def finish(batch: pa.RecordBatch, flat: list[int], met: list[int], after: int, first: bool, last: bool) -> pa.RecordBatch:
            n = batch.num_rows
            edge = np.zeros(n, np.int8)
            edge[0] |= first
            edge[-1] |= 2 * last
            shown = pa.array([k if e else None for k, e in zip(batch.column(1).to_pylist(), edge.tolist(), strict=True)], pa.string())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * depths), pa.array(flat, pa.int64()))
            reach = np.maximum(np.array(met), np.array([*met[1:], after])).astype(np.int32)
            made = [pa.array(np.full(n, part, np.int32)), pa.array(edge), shown, batch.column(0), lists, pa.array(reach)]
            return pa.RecordBatch.from_arrays([*batch.columns[2:], *made], names=[*others, "part", "edge", "edge_key", "edge_g", "starts", "reach"])

        opening = True
        for batch in batches:
            if not batch.num_rows:
                continue
            flat, met = [], []
            for g, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if before is None:
                    n, starts = UNKNOWN, [at] * depths
                else:
                    n = common_words(before[1], key) if before[0] == g else -1
                    valid = max(0, n - base + 1)
                    if valid < depths:
                        starts = starts[:valid] + [at] * (depths - valid)
                flat += starts
                met.append(n)
                before = g, key
                at += 1
            if held:
                yield finish(*held, met[0], opening, False)
                opening = False
            held = batch, flat, met
        if held:
            yield finish(*held, UNKNOWN, opening, True)

    dealt = rows.select("g", "key", *others).repartitionByRange(*order).sortWithinPartitions(*order)
    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in others), "part int, edge byte, edge_key string, edge_g long, starts array<long>, reach int"])
    done = stored(dealt.mapInArrow(scan, schema), name)
    names = join_edges(done.where("edge > 0").select("part", "edge", "edge_key", "edge_g", "starts").collect(), base, depths)
    if names:
        # at most one row a partition
        fixes = done.sparkSession.createDataFrame(names, "fix_part int, fix array<long>")
        home = F.shiftleft(F.col("part").cast("long"), PART_BITS)
        right = F.transform("starts", lambda s, i: F.when(s == home, F.get("fix", i)).otherwise(s))
        done = done.join(F.broadcast(fixes), F.col("part") == F.col("fix_part"), "left").withColumn("starts", F.when(F.col("fix").isNull(), F.col("starts")).otherwise(right))
    return done.select(*others, "starts", "reach")


def join_edges(edges: list[Row], base: int, depths: int) -> list[tuple[int, list[int]]]:
    """(partition, true names of the runs that its first row opens) where a run began in an earlier partition."""
    first, last = ({r["part"]: r for r in edges if r["edge"] & bit} for bit in (1, 2))
    out: list[tuple[int, list[int]]] = []
    before: tuple[int, str, list[int]] | None = None
    for part in sorted(first):
        a, z, home = first[part], last[part], part << PART_BITS
        fix = [home] * depths
        if before and before[0] == a["edge_g"]:
            valid = min(depths, max(0, common_words(before[1], a["edge_key"]) - base + 1))
            fix[:valid] = before[2][:valid]
            if valid:
                out.append((part, fix))
        before = z["edge_g"], z["edge_key"], [f if s == home else s for f, s in zip(fix, z["starts"], strict=True)]
    return out


def repeated_passages(docs: DataFrame, passage: int = PASSAGE, prefix: int = PREFIX) -> DataFrame:
    """Rows (doc_id, c1, c2, nth, spans) for documents with a passage that another text or row holds too.

    A passage is ``passage`` or more equal words in a row, whatever white space parts them.  spans:
    array of (start, end, first_doc, removed) in characters, in order; first_doc is the doc_id of
    the first document that holds the passage's windows, removed is false in that document.
    Windows of one first document join to one span; spans of different ones may overlap.  Documents
    are ordered by doc_id, nulls last, then by the 128-bit key (c1, c2) of their text: documents
    that share an id, or have none, are told apart by their texts.  A row whose text equals that
    of a smaller doc_id (or of another row with its id) is one removed span (0, -1); nth numbers
    rows with equal id and text.  Shorter texts, null and empty ones never appear.  Repeats inside
    one text alone aren't passages across documents and don't appear.
    """
    depths = passage - prefix + 1
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *text_keys(), text_column().alias("text"))

    def retain(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, parts, sizes, shift = batch.column(3).to_pylist(), [], [], 0
        for a, b in by_bytes(texts, 1 << 20):
            n, t, key, m, near, far = runs(texts[a:b], passage, prefix)
            sizes.append(n)
            parts.append((t + a, key, m << 32 | near << 16 | far))
        t, key, spot = (np.concatenate(c) for c in zip(*parts, strict=True))
        # a text's equal prefixes travel as one row, however often it repeats itself
        order = np.lexsort((key, t))
        t, key, spot = t[order], key[order], spot[order]
        new = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (key[1:] != key[:-1])])) if len(t) else t
        each = pa.ListArray.from_arrays(pa.array(np.append(new, len(t)).astype(np.int32)), pa.array(spot))
        ends = pa.array(np.searchsorted(t[new], np.arange(len(texts) + 1)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, v) for v in (pa.array(key[new]), each)]
        return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.concatenate(sizes)), *lists], names=["doc_id", "c1", "c2", "n_words", "prefixes", "spots"])

    signed = map_arrow(base, retain, "doc_id long, c1 long, c2 long, n_words long, prefixes array<long>, spots array<array<long>>")
    signed = stored(signed.withColumn("row_no", F.monotonically_increasing_id()), "suffixes").where(F.col("n_words") >= passage)
    kept = signed.groupBy("c1", "c2").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.min("row_no").alias("rep_no"))
    order = [F.col("first_id").isNull(), F.col("first_id"), F.col("c1"), F.col("c2")]
    # a text's place in the order of documents is its number from here on
    contents = stored(kept.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("ord", F.monotonically_increasing_id()), "contents")

    listed = signed.select("row_no", "prefixes", "spots").join(contents.select("rep_no", "ord"), F.col("row_no") == F.col("rep_no"))
    suffixes = stored(listed.select("ord", F.explode(F.arrays_zip("prefixes", "spots")).alias("x")).select("ord", F.col("x.prefixes").alias("prefix"), F.col("x.spots").alias("spots")), "listed")
    shared = suffixes.groupBy(F.col("prefix").alias("p")).agg(F.min("ord").alias("a"), F.max("ord").alias("b")).where("a <> b").select("p")
    spots = suffixes.join(shared, F.col("prefix") == F.col("p"), "left_semi").groupBy(F.col("ord").alias("s_ord")).agg(F.flatten(F.collect_list("spots")).alias("spots"))
    number = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    wanted = spots.join(contents, F.col("s_ord") == F.col("ord")).select(F.col("c1").alias("w1"), F.col("c2").alias("w2"), number(F.col("first_id")).alias("w_id"), "ord", "first_id", "spots")
    # one row of each wanted text
    held = base.select("c1", "c2", number(F.col("doc_id")).alias("t_id"), "text")
    texts = held.join(wanted, (F.col("c1") == F.col("w1")) & (F.col("c2") == F.col("w2")) & (F.col("t_id") == F.col("w_id"))).dropDuplicates(["c1", "c2", "t_id"]).select("ord", "first_id", "spots", "text")

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                text = batch.column(3)[k].as_py()
                w = words([text])
                shown = [x if len(x) <= WORD_CHARS else "#" + hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in text.split()]
                starts, ends = char_offsets(text, w.starts), char_offsets(text, w.ends)
                spans = starts[: len(shown) - passage + 1] << 32 | ends[passage - 1 :]
                # a text's equal suffixes travel as one row, however often it repeats itself
                found: dict[tuple[str, str, int, int], list[int]] = {}
                for spot in batch.column(2)[k].values.to_pylist():
                    m, near, far = spot >> 32, spot >> 16 & 0xFFFF, spot & 0xFFFF
                    right = " ".join(shown[m : m + passage - near]) + " "
                    left = " ".join(shown[m - far : m][::-1]) + " " if far else ""
                    found.setdefault((right, left, near, far), []).append(m)
                rows = list(found)
                at = [np.stack([spans[np.array(m) - o] for o in range(near, far + 1)]) for (_, _, near, far), m in found.items()]
                inner = np.concatenate([np.full(len(x), x.shape[1]) for x in at])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(inner)]).astype(np.int32)), pa.array(np.concatenate([x.ravel() for x in at])))
                outer = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in at])]).astype(np.int32)), lists)
                right, left, near, far = zip(*rows, strict=True)
                n = len(rows)
                number, first = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                cols = [pa.array([0] * n, pa.int64()), pa.array(right), pa.array(left), pa.array([number] * n, pa.int64()), pa.array([first] * n, pa.int64()), pa.array(near, pa.int32()), pa.array(far, pa.int32()), outer]
                yield pa.RecordBatch.from_arrays(cols, names=["g", "key", "left", "ord", "first_id", "near", "far", "pos"])

    made = stored(texts.mapInArrow(extend, "g long, key string, left string, ord long, first_id long, near int, far int, pos array<array<long>>"), "right-keys")
    after = sorted_runs(made, prefix, depths, "right-sorted").withColumnsRenamed({"starts": "right_of", "reach": "r_reach"})
    # windows that no neighbour's words reach hold no repeated passage
    close = after.withColumn("low", F.greatest("near", F.lit(passage) - F.col("r_reach"))).where("low <= far")
    before = sorted_runs(close.withColumn("g", F.col("right_of")[0]).withColumnRenamed("left", "key"), 0, depths, "left-sorted")
    offsets = F.explode(F.sequence("low", F.least("far", "reach"))).alias("o")
    windows = before.where("low <= reach").select("ord", "first_id", "near", "pos", "starts", "right_of", offsets)
    windows = stored(windows.select("o", F.get("starts", F.col("o")).alias("l"), F.get("right_of", F.lit(depths - 1) - F.col("o")).alias("r"), "ord", "first_id", F.get("pos", F.col("o") - F.col("near")).alias("pos")), "windows")
    again = windows.groupBy(F.col("o").alias("ao"), F.col("l").alias("al"), F.col("r").alias("ar")).agg(F.min("ord").alias("keeper"), F.max("ord").alias("b"), F.min("first_id").alias("keeper_id")).where("keeper <> b").drop("b")
    same = (F.col("o") == F.col("ao")) & (F.col("l") == F.col("al")) & (F.col("r") == F.col("ar"))
    hits = windows.join(again, same).groupBy("ord").agg(F.collect_list(F.struct("pos", "keeper", "keeper_id")).alias("hits"))

    def spans(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for k, own in enumerate(batch.column(0).to_pylist()):
            v = batch.column(1)[k].values
            lists, keeper, ids = v.field("pos"), v.field("keeper").to_numpy(), v.field("keeper_id").to_pylist()
            id_of = dict(zip(keeper.tolist(), ids, strict=True))
            pos, keeper = lists.flatten().to_numpy(), np.repeat(keeper, lists.value_lengths().to_numpy())
            order = np.argsort(keeper, kind="stable")
            pos, keeper = pos[order], keeper[order]
            found = []
            for part in np.split(np.arange(len(keeper)), np.flatnonzero(keeper[1:] != keeper[:-1]) + 1):
                who = int(keeper[part[0]])
                found += [{"start": a, "end": b, "first_doc": id_of[who], "removed": who != own} for a, b in merge(pos[part])]
            out.append(sorted(found, key=lambda x: (x["start"], x["end"], x["removed"])))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("first_doc", pa.int64()), ("removed", pa.bool_())]))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], names=["s_ord", "spans"])

    spanned = map_arrow(hits, spans, f"s_ord long, spans {SPANS}")
    by_content = contents.join(spanned, F.col("ord") == F.col("s_ord"), "left").where("copies > 1 or s_ord is not null").select(F.col("c1").alias("k1"), F.col("c2").alias("k2"), "first_id", "spans")
    # of several rows with the smallest id of a text, one stays
    times = signed.groupBy("doc_id", "c1", "c2").agg(F.count(F.lit(1)).cast("int").alias("times"))
    rows = times.select("doc_id", "c1", "c2", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("nth"))
    whole = lambda removed: F.array(F.struct(F.lit(0).cast("long").alias("start"), F.lit(-1).cast("long").alias("end"), F.col("first_id").alias("first_doc"), F.lit(removed).alias("removed")))
    first = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("nth") == 1)
    return rows.join(by_content, (F.col("c1") == F.col("k1")) & (F.col("c2") == F.col("k2"))).select(
        "doc_id", "c1", "c2", "nth", F.when(~first, whole(True)).when(F.col("spans").isNotNull(), F.col("spans")).otherwise(whole(False)).cast(SPANS).alias("spans")
    )


def cut_passages(docs: DataFrame, passage: int = PASSAGE, prefix: int = PREFIX) -> DataFrame:
    """Documents without the removed spans; a document of which no word is left goes.

    Other columns are kept; n_chars, where there is one, is counted again.  One row of several equal
    ones with one id stays.
    """
    found = repeated_passages(docs, passage, prefix).where(F.exists("spans", lambda s: s["removed"]))
    whole = F.col("spans")[0]["end"] == -1
    actions = found.groupBy(F.col("doc_id").alias("a_id"), F.col("c1").alias("a1"), F.col("c2").alias("a2")).agg(
        F.first(F.when(~whole, F.col("spans")), ignorenulls=True).alias("cuts"), F.min(F.when(whole, F.col("nth"))).alias("low")
    )
    c1, c2 = text_keys()
    hashed = docs.select(F.struct(*docs.columns).alias("cut_row"), F.col("doc_id").cast("long").alias("cut_id"), c1.alias("cut_1"), c2.alias("cut_2"))
    left = hashed.join(actions, F.col("cut_id").eqNullSafe(F.col("a_id")) & (F.col("cut_1") == F.col("a1")) & (F.col("cut_2") == F.col("a2")), "left")
    # rows of one id and text: all go, or all but one
    nth = F.row_number().over(Window.partitionBy("cut_id", "cut_1", "cut_2").orderBy("cut_1"))
    left = left.withColumn("cut_nth", nth).where("low is null or (low > 1 and cut_nth = 1)")
    pieces = F.filter("cuts", lambda s: s["removed"])
    text = F.col("cut_row.text")
    acc = F.aggregate(
        pieces,
        F.struct(F.lit("").alias("t"), F.lit(0).cast("long").alias("at")),
        lambda s, x: F.struct(
            F.concat(s["t"], F.substring(text, (s["at"] + 1).cast("int"), F.greatest(x["start"] - s["at"], F.lit(0)).cast("int"))).alias("t"),
            F.greatest(x["end"], s["at"]).alias("at"),
        ),
    )
    rest = F.concat("cut_state.t", F.substring(text, (F.col("cut_state.at") + 1).cast("int"), F.length(text)))
    done = left.withColumn("cut_state", acc).withColumn("cut_text", F.when(F.col("cuts").isNull(), text).otherwise(rest))
    done = done.where(F.col("cuts").isNull() | F.col("cut_text").rlike(f"[^{SPACES}]"))
    changed = {"text": F.col("cut_text"), "n_chars": F.when(F.col("cuts").isNull(), F.col("cut_row.n_chars")).otherwise(F.length("cut_text")).cast("long")} if "n_chars" in docs.columns else {"text": F.col("cut_text")}
    return done.select(*(changed[c].alias(c) if c in changed else F.col(f"cut_row.`{c}`") for c in docs.columns))
