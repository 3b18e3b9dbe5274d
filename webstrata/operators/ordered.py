"""Rows dealt by ranges of an order and stored: places and leading rows without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

#: Leading rows that tasks may pass on to one task, which merges them.
TOP = 10_000
#: Bits of a row's number inside its task, in Spark's increasing ids.
_ROW_BITS = 33


def in_ranges(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` range-partitioned and sorted, stored with ``o_part`` (ascending with the order) and ``o_at`` (place in the part, from 0).

    Stored, as a second run of the plan might draw other ranges.
    """
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("o_id", F.monotonically_increasing_id())
    return stored(dealt.withColumns({"o_part": F.shiftright("o_id", _ROW_BITS), "o_at": F.col("o_id").bitwiseAND((1 << _ROW_BITS) - 1)}).drop("o_id"), name)


def part_totals(dealt: DataFrame, value: Column | None = None) -> list[tuple[int, int]]:
    """(part, sum of ``value``, or number of rows) in order: one row a partition."""
    total = F.count(F.lit(1)) if value is None else F.coalesce(F.sum(value), F.lit(0))
    return [(r[0], r[1]) for r in dealt.groupBy("o_part").agg(total).orderBy("o_part").collect()]


def with_total_before(dealt: DataFrame, value: str) -> tuple[DataFrame, int]:
    """(rows with ``o_before``, the sum of ``value`` over all rows before; the sum over all): sums of parts, one row each, tell where a part starts."""
    begins, at = [], 0
    for part, n in part_totals(dealt, F.col(value)):
        begins.append((part, at))
        at += n
    known = F.broadcast(dealt.sparkSession.createDataFrame(begins, "b_part long, b_at long"))
    inside = F.sum(value).over(Window.partitionBy("o_part").orderBy("o_at").rowsBetween(Window.unboundedPreceding, 0)) - F.col(value)
    return dealt.join(known, F.col("o_part") == F.col("b_part")).withColumn("o_before", F.col("b_at") + inside).drop("b_part", "b_at"), at


def leading_rows(rows: DataFrame, order: list[Column], n: int, top: int = TOP) -> DataFrame:
    """The first ``n`` rows of the order, sorted.

    Up to ``top`` rows each task passes on its own first ones.  Beyond, rows are dealt by ranges and
    numbered where they lie; the counts of the ranges tell where the n-th row is, and a filter on
    range and place takes the rest: no task sees more than a range.
    """
    if n <= top:
        return rows.orderBy(*order).limit(n)
    dealt, left = in_ranges(rows, order, "leading"), n
    last, places = -1, 0  # the part that is cut, and rows taken from it
    for part, count in part_totals(dealt):
        last, places = part, min(count, left)
        left -= places
        if not left:
            break
    kept = dealt.where((F.col("o_part") < last) | ((F.col("o_part") == last) & (F.col("o_at") < places)))
    return kept.drop("o_part", "o_at").orderBy(*order)
