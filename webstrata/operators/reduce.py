"""Distinct, collapse, newest and oldest, ordered limit and resume."""

from __future__ import annotations

import re
from functools import reduce as fold

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ConfigError
from ..functions.fields import capture_key, stamp
from ..plans.query import Collapse
from ..schema import TOTAL_ORDER
from .ordered import leading_rows


def total_order(captures: DataFrame, last_first: bool = False) -> list[Column]:
    """The order that replaces arrival order, or its reverse; without ``crawl_ord`` newer ids of crawls come first."""
    ranked = "crawl_ord" in captures.columns
    first = F.col("crawl_ord" if ranked else "crawl")
    if last_first:
        return [first.desc() if ranked else first.asc(), *(F.desc(c) for c in TOTAL_ORDER[1:])]
    return [first.asc() if ranked else first.desc(), *(F.col(c) for c in TOTAL_ORDER[1:])]


def first_per(captures: DataFrame, *keys: Column) -> DataFrame:
    """The first row of each key: a ranked window, of which each task passes on one row a key."""
    w = Window.partitionBy(*keys).orderBy(*total_order(captures))
    return captures.withColumn("pick_rank", F.row_number().over(w)).where("pick_rank = 1").drop("pick_rank")


def distinct_urls(captures: DataFrame) -> DataFrame:
    return first_per(captures, F.col("urlkey"))


def collapse(captures: DataFrame, how: Collapse) -> DataFrame:
    """One row for each value within the whole result, or only of neighbours in (urlkey, timestamp) order if ``adjacent``."""
    key = {"digest": F.col("digest"), "urlkey": F.col("urlkey"), "timestamp": F.left(stamp(F.col("timestamp")), F.lit(how.digits))}[how.by]
    if how.adjacent:
        w = Window.partitionBy("urlkey").orderBy("timestamp", *total_order(captures))
        before = captures.withColumn("pick_key", key).withColumn("pick_last", F.lag("pick_key").over(w)).withColumn("pick_n", F.row_number().over(w))
        return before.where((F.col("pick_n") == 1) | ~F.col("pick_key").eqNullSafe(F.col("pick_last"))).drop("pick_key", "pick_last", "pick_n")
    return first_per(captures, F.col("urlkey"), key) if how.by == "timestamp" else first_per(captures, key)


def newest(captures: DataFrame, n: int = 1) -> DataFrame:
    return leading_rows(captures, [F.desc("timestamp"), *total_order(captures)], n)


def oldest(captures: DataFrame, n: int = 1) -> DataFrame:
    return leading_rows(captures, [F.col("timestamp"), *total_order(captures)], n)


def newest_ok_per_url(captures: DataFrame) -> DataFrame:
    """The newest capture with status 200 of each URL key."""
    w = Window.partitionBy("urlkey").orderBy(F.desc("timestamp"), *total_order(captures))
    return captures.where("status = 200").withColumn("pick_rank", F.row_number().over(w)).where("pick_rank = 1").drop("pick_rank")


def ordered_limit(captures: DataFrame, n: int) -> DataFrame:
    return leading_rows(captures, total_order(captures), n)


def resume_token(captures: DataFrame) -> Column:
    """A capture's key, and behind it its time and URL key, so that nothing has to be looked up to go on after it."""
    at = F.unix_micros(F.col("timestamp").cast("timestamp")).cast("string")
    return F.concat_ws("@", capture_key(F.col("crawl"), F.col("filename"), F.col("offset")), at, F.col("urlkey"))


def order_of(captures: DataFrame, token: str) -> dict[str, object]:
    """Values of the total order of the capture that a resume token names.

    A bare capture key is looked up in its crawl; of a whole token only the crawl's place is, which
    any one row of the crawl tells.
    """
    m = re.fullmatch(r"(?s)([^:]*):(.+):(\d+?)(?:@(-?\d+)@(.*))?", token)
    if not m:
        raise ConfigError(f"no resume token: {token!r}")
    crawl, filename, offset, at, urlkey = m.groups()
    rows = captures.where(F.col("crawl") == crawl)
    ranked = ["crawl_ord"] if "crawl_ord" in captures.columns else []
    if at is None:
        row = rows.where((F.col("filename") == filename) & (F.col("offset") == int(offset))).select("crawl", *ranked, *TOTAL_ORDER[1:]).first()
    else:
        row = rows.select("crawl", *ranked).first()
    if row is None:
        raise ConfigError(f"no capture {token!r} to resume after")
    if at is None:
        return row.asDict()
    time = F.timestamp_micros(F.lit(int(at))).cast(dict(captures.dtypes)["timestamp"])
    return row.asDict() | {"urlkey": urlkey, "timestamp": time, "filename": filename, "offset": int(offset)}


def resume_after(captures: DataFrame, after: dict[str, object] | str) -> DataFrame:
    """Rows behind the given values of the total order, or behind the capture that a resume token names."""
    place = order_of(captures, after) if isinstance(after, str) else after
    first = ["crawl_ord"] if "crawl_ord" in captures.columns else ["crawl"]
    names = [c for c in (*first, *TOTAL_ORDER[1:]) if c in place]
    steps = []
    for i, c in enumerate(names):
        same = [F.col(x) == F.lit(place[x]) for x in names[:i]]
        behind = F.col(c) < F.lit(place[c]) if c == "crawl" else F.col(c) > F.lit(place[c])
        steps.append(fold(lambda a, b: a & b, [*same, behind]))
    return captures.where(fold(lambda a, b: a | b, steps))


def stats_by_crawl(captures: DataFrame) -> DataFrame:
    return captures.groupBy("crawl").agg(F.count(F.lit(1)).alias("captures"), F.sum("length").alias("bytes"), F.countDistinct("urlkey").alias("urls"))


#: Logarithm of a sketch's registers: distinct counts err by about 1.6 % in the mean.
SKETCH = 12


def crawl_sketches(captures: DataFrame) -> DataFrame:
    """(crawl, captures, bytes, urls, digests): exact sums, and HyperLogLog sketches that may be united."""
    return captures.groupBy("crawl").agg(F.count(F.lit(1)).alias("captures"), F.sum("length").alias("bytes"), F.hll_sketch_agg("urlkey", SKETCH).alias("urls"), F.hll_sketch_agg("digest", SKETCH).alias("digests"))


def sketched_stats(sketches: DataFrame) -> DataFrame:
    """(crawl, captures, bytes, urls, digests), the last two estimated; rows of one ``crawl`` are united, a URL of several counted once."""
    some = [F.hll_sketch_estimate(F.hll_union_agg(c)).alias(c) for c in ("urls", "digests")]
    return sketches.groupBy("crawl").agg(F.sum("captures").alias("captures"), F.sum("bytes").alias("bytes"), *some)
