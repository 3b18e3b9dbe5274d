"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

Each source gets a mean repetition rate so that its expected share of characters is its target
weight.  A document's repeat count inverts the Poisson distribution at a uniform number hashed
from its id, so the result depends on the rows alone: not on partitioning, retries or order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_dir

#: Largest rate inverted in one step; larger rates are sums of independent Poisson counts.
STEP_RATE = 16.0
#: Terms kept of each distribution: P(X > 80) is below 1e-28 at rate 16, less than the hash resolves.
TERMS = 80
#: Rate tables of at most this many sources are broadcast (under 1 KB a row), larger ones are joined by shuffle.
BROADCAST_SOURCES = 20_000


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from 52 bits of the MD5 of the parts."""
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double")
    return (bits + F.lit(0.5)) / F.lit(float(2**52))


def source_rates(docs: DataFrame, weights: DataFrame | None = None, epochs: float = 1.0, most_repeats: float | None = None) -> DataFrame:
    """One row a source: ``rate`` (mean repeats), ``steps`` and the cumulative distribution of one step.

    weights: (source, weight) with any positive scale, rows that repeat a source add up; by default
    the square root of a source's characters (temperature 2).  Sources with no characters or no
    positive weight get rate 0.  epochs: expected characters out per character in.  most_repeats: no
    source's rate is larger; the others keep theirs, so that the output is smaller and a held source
    misses its weight.  Without it a tiny source with a large weight repeats as often as that asks.
    """
    sizes = docs.groupBy(F.col("source").alias("mix_source")).agg(F.sum(F.length("text")).cast("double").alias("chars"))
    if weights is None:
        sizes = sizes.withColumn("weight", F.sqrt("chars"))
    else:
        w = weights.groupBy(F.col("source").alias("w_source")).agg(F.sum(F.col("weight").cast("double")).alias("weight"))
        sizes = sizes.join(w, F.col("mix_source").eqNullSafe(F.col("w_source")), "left").drop("w_source")
    sizes = sizes.where("chars > 0 and weight > 0").checkpoint()
    # two numbers, from partial sums
    total = sizes.agg(F.sum("weight").alias("weight"), F.sum("chars").alias("chars")).first()
    sized = sizes.select("mix_source", (F.col("weight") / F.lit(total["weight"]) * F.lit(total["chars"]) * F.lit(float(epochs)) / F.col("chars")).alias("rate"))
    if most_repeats is not None:
        sized = sized.withColumn("rate", F.least("rate", F.lit(float(most_repeats)))).where("rate > 0")
    step = F.col("rate") / F.col("steps")
    grown = F.aggregate(
        F.sequence(F.lit(1), F.lit(TERMS)),
        F.array(F.struct(F.exp(-step).alias("p"), F.exp(-step).alias("f"))),
        lambda acc, i: F.concat(
            acc,
            F.array(
                F.struct(
                    (F.element_at(acc, -1)["p"] * step / i).alias("p"),
                    (F.element_at(acc, -1)["f"] + F.element_at(acc, -1)["p"] * step / i).alias("f"),
                )
            ),
        ),
    )
    return sized.withColumn("steps", F.ceil(F.col("rate") / F.lit(STEP_RATE)).cast("int")).select(
        "mix_source", "rate", "steps", F.transform(grown, lambda x: x["f"]).alias("cdf")
    )


def mix_sources(docs: DataFrame, weights: DataFrame | None = None, epochs: float = 1.0, seed: str = "mix", most_repeats: float | None = None) -> DataFrame:
    """Repeat documents so that sources reach their target weights, then shuffle globally.

    docs: at least (doc_id, text, source); every column is kept, ``copy_no`` (from 1) and
    ``shuffle_key`` are added (a clashing input column is replaced), rows come ordered by the key.
    Null or empty texts count no characters but are repeated as their source is; a null source is a
    source of its own; rows with equal ids (null included) get equal counts; an empty table gives
    an empty one.  A hot source never meets in one task: rates come from partial sums and reach the
    documents by a broadcast whose size was counted, or by a join that adaptive execution splits.
    """
    shared_dir(docs.sparkSession)  # for checkpoints
    rates = source_rates(docs, weights, epochs, most_repeats).checkpoint()
    if rates.count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    packed = docs.select(F.struct(*docs.columns).alias("mix_row"), F.col("source").alias("mix_of"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("mix_id"))
    drawn = F.transform(F.sequence(F.lit(1), F.col("steps")), lambda i: uniform(F.lit(seed), F.col("mix_id"), i.cast("string")))
    draws = F.transform(drawn, lambda u: F.size(F.filter("cdf", lambda f: f < u)))
    keep = [F.col(f"mix_row.`{c}`") for c in docs.columns if c not in ("copy_no", "shuffle_key")]
    return (
        packed.join(rates, F.col("mix_of").eqNullSafe(F.col("mix_source")))
        .withColumn("mix_copies", F.aggregate(draws, F.lit(0), lambda a, x: a + x))
        .where("mix_copies > 0")
        .select("mix_row", "mix_id", F.explode(F.sequence(F.lit(1), F.col("mix_copies"))).alias("copy_no"))
        .withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(seed), "mix_id", F.col("copy_no").cast("string"))))
        .orderBy("shuffle_key", "mix_id", "copy_no")
        .select(*keep, "copy_no", "shuffle_key")
    )


ORACLE = f"""
with sizes as (select source, cast(sum(length(text)) as double) chars from documents group by source),
w as (select source, chars, sqrt(chars) weight from sizes where chars > 0),
r as (select source, weight / sum(weight) over () * sum(chars) over () / chars rate from w),
s as (select source, rate, cast(ceil(rate / {STEP_RATE}) as integer) steps from r),
p as (select source, steps, k.k, exp(-(rate/steps)) * exp(k.k * ln(rate/steps) - lgamma(k.k + 1)) p
      from s, (select unnest(range(0, {TERMS + 1})) k) k),
c as (select source, steps, list(f order by k) cdf from (
        select source, steps, k, sum(p) over (partition by source order by k) f from p) group by source, steps),
d as (select documents.*, c.steps, c.cdf from documents join c on documents.source is not distinct from c.source),
n as (select *, list_sum(list_transform(range(1, steps + 1), lambda i: len(list_filter(cdf, lambda f: f <
        (cast(cast('0x' || substr(md5('mix:' || coalesce(cast(doc_id as varchar), 'null') || ':' || i), 1, 13) as bigint) as double)
          + 0.5) / 4503599627370496.0)))) copies from d)
select doc_id, text, lang, source, n_chars, cast(copy_no as integer) copy_no,
       md5('mix:' || coalesce(cast(doc_id as varchar), 'null') || ':' || copy_no) shuffle_key
from (select *, unnest(range(1, cast(copies as bigint) + 1)) copy_no from n where copies > 0)
"""
