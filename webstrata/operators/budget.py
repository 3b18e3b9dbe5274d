"""Run limits: records and bytes, with a resume key.

``within_*`` are plans; ``spend`` is the action that also tells whether rows were left.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import BudgetExhaustedError, IndexTooLargeError
from ..session import stored
from .ordered import in_ranges, leading_rows, part_totals
from .reduce import resume_token, total_order

#: Index pages of a crawl that a search reads at most.
MAX_PAGES = 1000


@dataclass(frozen=True)
class Budget:
    records: int | None = None
    bytes: int | None = None
    pages: int | None = None


def within_records(captures: DataFrame, n: int) -> DataFrame:
    return leading_rows(captures, total_order(captures), n)


def within_bytes(captures: DataFrame, most: int) -> DataFrame:
    """The longest leading run of rows whose lengths sum to ``most`` at most."""
    return leading_bytes(captures, most)[0]


def leading_bytes(captures: DataFrame, most: int) -> tuple[DataFrame, bool]:
    """(the longest leading run within ``most`` bytes, whether a row was left).

    The plan runs once: rows are dealt by ranges and stored.  Sums of the ranges, one row each, tell
    which of them the budget cuts; those before it stay whole, and it alone is summed row by row.
    """
    dealt = in_ranges(captures, total_order(captures), "budget-ranges")
    spent, cut = 0, None
    for part, n in part_totals(dealt, F.col("length")):
        if spent + n > most:
            cut = part
            break
        spent += n
    if cut is None:
        return dealt.drop("o_part", "o_at"), False
    w = Window.partitionBy("o_part").orderBy("o_at").rowsBetween(Window.unboundedPreceding, 0)
    last = dealt.where(F.col("o_part") == cut).withColumn("b_run", F.sum("length").over(w)).where(F.col("b_run") <= most - spent)
    return dealt.where(F.col("o_part") < cut).unionByName(last.drop("b_run")).select(*captures.columns), True


def spend(captures: DataFrame, budget: Budget, pages: dict[str, int] | None = None) -> tuple[DataFrame, BudgetExhaustedError | None]:
    """Rows within the budget, and the error to raise after them if rows were left.

    The plan runs once: rows within the budget, and with a record budget one more, are stored.  pages:
    index pages by crawl, for a page budget, which is checked before anything runs.
    """
    if budget.pages is not None:
        check_pages(pages or {}, budget.pages)
    if budget.records is None and budget.bytes is None:
        return captures, None
    what = ""
    kept = captures
    if budget.records is not None:
        kept = stored(within_records(kept, budget.records + 1), "budget-records")
        if kept.count() > budget.records:
            what = "record"
            kept = within_records(kept, budget.records)
    if budget.bytes is not None:
        kept, cut = leading_bytes(kept, budget.bytes)
        what = "byte" if cut else what
    if not what:
        return kept, None
    last = kept.orderBy(*total_order(kept, last_first=True)).select(resume_token(kept).alias("k")).first()
    return kept, BudgetExhaustedError(what, last["k"] if last else None)


def check_pages(pages: dict[str, int], most: int = MAX_PAGES) -> None:
    """Raises before anything is read if a crawl has too many index pages."""
    for crawl, n in pages.items():
        if n > most:
            raise IndexTooLargeError(crawl, n, most)
