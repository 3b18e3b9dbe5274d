"""Per-URL temporal sampling: captures dealt by ranges of key and time, and a scan whose state crosses the edges of ranges."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored

POLICIES = ("all", "unique-digest", "first-last", "first-last-digest", "adaptive")

_MARKS = ("s_begin", "s_change", "s_end", "s_head", "s_tail")


@dataclass(frozen=True)
class Sampling:
    policy: str = "first-last-digest"
    most: int = 8  # of adaptive

    @classmethod
    def parse(cls, text: str) -> Sampling:
        """Unknown words mean first-last-digest."""
        word = text.strip().lower()
        return cls(word) if word in POLICIES else cls()


def sample(captures: DataFrame, how: Sampling | None = None, ordered: bool = True) -> DataFrame:
    """Rows that the policy keeps of each URL key; ties in time by (crawl_ord, filename, offset).

    all: every row.  unique-digest: the earliest of each digest.  first-last: both ends.
    first-last-digest: the ends and every row whose digest differs from the row before.  adaptive:
    of those at most ``most``, evenly spaced with both ends (0: no limit, 1: the first).

    The policies that look at neighbours run the plan once and store the rows that may stay; a key
    with however many captures is spread over as many tasks as its ranges.
    """
    how = how or Sampling()
    ties = ["crawl_ord"] if "crawl_ord" in captures.columns else []
    order = ["timestamp", *ties, "filename", "offset"]
    kept = captures
    if how.policy == "unique-digest":
        # a ranked window, of which each task passes on one row a digest
        per = Window.partitionBy("urlkey", "digest").orderBy(*order)
        kept = kept.withColumn("s_rn", F.row_number().over(per)).where("s_rn = 1")
    elif how.policy != "all":
        marked = in_marked_ranges(captures, order, ends_only=how.policy == "first-last")
        if how.policy == "first-last":
            kept = marked.where("s_begin or s_end")
        elif how.policy == "adaptive" and how.most == 1:
            kept = marked.where("s_begin")
        else:
            kept = marked.where("s_change or s_end")
            if how.policy == "adaptive" and how.most > 1:
                kept = evenly(kept, [F.col(c) for c in order], how.most)
    kept = kept.select(*captures.columns)
    return kept.orderBy("urlkey", *order) if ordered else kept


def in_marked_ranges(captures: DataFrame, order: list[str], ends_only: bool) -> DataFrame:
    """Captures that may stay, stored, with s_part, s_begin (first of its key), s_change (digest unlike the row before) and s_end (last of its key).

    Each range is scanned once, row against row before, and passes on its ends and its changes
    alone.  The first and last row of a range, two a range, then meet their neighbours beyond the
    edge, which settles the marks that the scan couldn't.
    """
    names = captures.columns
    key, digest = names.index("urlkey"), names.index("digest")

    def same(a: pa.Array, b: pa.Array) -> pa.Array:
        return pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))

    def marked(rows: pa.RecordBatch, begin: pa.Array, change: pa.Array, end: pa.Array, head: bool, tail: bool, part: int) -> pa.RecordBatch:
        n = rows.num_rows
        first = pa.array([head and k == 0 for k in range(n)]) if head else pa.repeat(False, n)
        last = pa.array([k == n - 1 for k in range(n)]) if tail else pa.repeat(False, n)
        out = pa.RecordBatch.from_arrays([*rows.columns, begin, change, end, first, last, pa.repeat(pa.scalar(part, pa.int32()), n)], names=[*names, *_MARKS, "s_part"])
        stay = pc.or_(pc.or_(begin if ends_only else change, end), pc.or_(first, last))
        return out.filter(stay)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, held, head = TaskContext.get().partitionId(), None, True
        begin = change = pa.array([True])  # of the row that is held back until its successor is known
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch if held is None else pa.concat_batches([held, batch])
            n = rows.num_rows
            again = same(rows.column(key).slice(0, n - 1), rows.column(key).slice(1))
            alike = pc.and_(again, same(rows.column(digest).slice(0, n - 1), rows.column(digest).slice(1)))
            begins, changes = (pa.concat_arrays([first, pc.invert(x)]) for first, x in ((begin, again), (change, alike)))
            if n > 1:
                yield marked(rows.slice(0, n - 1), begins.slice(0, n - 1), changes.slice(0, n - 1), pc.invert(again), head, False, part)
                head = False
            held, begin, change = rows.slice(n - 1), begins.slice(n - 1), changes.slice(n - 1)
        if held is not None:
            yield marked(held, begin, change, pa.array([True]), head, True, part)

    schema = T.StructType([*captures.schema.fields, *(T.StructField(m, T.BooleanType()) for m in _MARKS), T.StructField("s_part", T.IntegerType())])
    dealt = captures.repartitionByRange("urlkey", *order).sortWithinPartitions("urlkey", *order)
    rows = stored(dealt.mapInArrow(run, schema), "sampled")
    edges = rows.where("s_head or s_tail").select("s_part", "s_head", "s_tail", "urlkey", "digest").collect()
    heads, tails = ({r["s_part"]: (r["urlkey"], r["digest"]) for r in edges if r[side]} for side in ("s_head", "s_tail"))
    parts = sorted(heads)
    settled = []
    for k, part in enumerate(parts):
        before, after = (tails[parts[k - 1]] if k else None), (heads[parts[k + 1]] if k + 1 < len(parts) else None)
        settled.append((part, before is not None and before[0] == heads[part][0], before == heads[part], after is not None and after[0] == tails[part][0]))
    # a row a range
    known = F.broadcast(captures.sparkSession.createDataFrame(settled, "e_part int, e_before boolean, e_same boolean, e_after boolean"))

    def unless(mark: str, edge: str, said: str) -> Column:
        return F.col(mark) & ~(F.col(edge) & F.col(said))

    return rows.join(known, F.col("s_part") == F.col("e_part")).select(
        *names, "s_part", unless("s_begin", "s_head", "e_before").alias("s_begin"), unless("s_change", "s_head", "e_same").alias("s_change"), unless("s_end", "s_tail", "e_after").alias("s_end")
    )


def evenly(kept: DataFrame, order: list[Column], most: int) -> DataFrame:
    """At most ``most`` rows a key, evenly spaced with both ends; rows are numbered in their range, behind the rows of their key in ranges before."""
    counts = kept.groupBy("urlkey", "s_part").agg(F.count(F.lit(1)).alias("c_n"))
    # one row a key and range
    before, every = Window.partitionBy("urlkey").orderBy("s_part"), Window.partitionBy("urlkey")
    counts = counts.select(F.col("urlkey").alias("c_key"), F.col("s_part").alias("c_part"), (F.sum("c_n").over(before) - F.col("c_n")).alias("c_before"), (F.sum("c_n").over(every) - 1).alias("s_l"))
    inside = Window.partitionBy("urlkey", "s_part").orderBy(*order)
    rows = kept.withColumn("s_at", F.row_number().over(inside) - 1).join(counts, F.col("urlkey").eqNullSafe(F.col("c_key")) & (F.col("s_part") == F.col("c_part")))
    # row r of L+1 is the i-th pick iff r = i*L div M for some i
    r, last, m = F.col("s_at") + F.col("c_before"), F.greatest(F.col("s_l"), F.lit(1)), F.lit(most - 1)
    i = F.floor((r * m + last - 1) / last)
    return rows.where((F.col("s_l") < most) | (F.floor(i * last / m) == r))
