"""How far the term use of a language's sources diverges, source against source and source against language.

Documents become counts a (lang, source, term) inside their tasks; only counts are shuffled.  Kept
terms get numbers inside buckets of bounded size, so a group is a few sorted (term number, count)
arrays.  Each unordered pair of sources and each bucket is one task of its own: the two arrays are
co-grouped, a galloping intersection finds the terms that both have, and the overlap, either side's
own terms and the terms that both lack are priced, for both directions at once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import few, stored

#: Documents of its language that a kept term is in, at least.
LEAST_DOCS = 30
#: Smoothing count, and units of a share.
ADDED, UNITS = 5, 1_000_000_000
#: Terms of a bucket, about.
BUCKET = 1 << 12
#: Ranks of the part ``term``.
TOP = 50
#: Entries that a task counts before it passes them on, and bytes of a text at once.
HELD, CHUNK = 1_000_000, 1 << 24

# Letters count, of ASCII A-Z and a-z in lower case and every byte beyond ASCII.
_LETTERS = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def terms_of(text: str) -> Iterator[list[bytes]]:
    """Terms of a text, in lists for its parts."""
    data = text.encode().translate(_LETTERS)
    at = 0
    while at < len(data):
        stop = data.find(b" ", at + CHUNK) if len(data) - at > CHUNK else len(data)
        stop = len(data) if stop < 0 else stop
        yield data[at:stop].split()
        at = stop


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, several rows a term; a null term for every group."""
    names = ["lang", "source", "term", "n", "docs"]

    def rows(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, in_docs) in held.items():
            terms = [None, *n]
            cols = pa.array(terms, pa.binary()).cast(pa.string()), pa.array([0, *n.values()], pa.int64()), pa.array([0, *map(in_docs.__getitem__, n)], pa.int64())
            batch = pa.RecordBatch.from_arrays([pa.array([lang] * len(terms)), pa.array([source] * len(terms)), *cols], names=names)
            yield from (batch.slice(k, 50_000) for k in range(0, len(terms), 50_000))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0
        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n, in_docs = held.setdefault((lang, source), (Counter(), Counter()))
                before, seen = len(n), set()
                for terms in terms_of(text):
                    n.update(terms)
                    seen.update(terms)
                in_docs.update(seen)
                size += len(n) - before
                if size >= HELD:
                    yield from rows(held)
                    held, size = {}, 0
        yield from rows(held)

    filled = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text"))
    return docs.select(*filled).mapInArrow(run, "lang string, source string, term string, n long, docs long")


def gallop(wanted: np.ndarray, among: np.ndarray) -> np.ndarray:
    """First place in ``among`` (sorted) that isn't below each wanted number: steps that double until they pass it, then halving inside the last step."""
    n = len(among)
    low, step = np.zeros(len(wanted), np.int64), np.ones(len(wanted), np.int64)
    going = np.arange(len(wanted))
    while len(going):
        at = low[going] + step[going] - 1
        going = going[(at < n) & (among[np.minimum(at, n - 1)] < wanted[going])] if n else going[:0]
        low[going] += step[going]
        step[going] *= 2
    high = np.minimum(low + step - 1, n)
    while len(open_ := np.flatnonzero(low < high)):
        middle = (low[open_] + high[open_]) // 2
        below = among[middle] < wanted[open_]
        low[open_[below]] = middle[below] + 1
        high[open_[~below]] = middle[~below]
    return low


def price(counts: np.ndarray, total: int, kept: int) -> np.ndarray:
    """1 + floor(UNITS * (count + ADDED) / (total + ADDED * kept)), by long division in steps of a thousand."""
    whole = total + ADDED * kept
    rest, out = counts.astype(np.int64) + ADDED, np.zeros(len(counts), np.int64)
    for _ in range(3):
        out = out * 1000 + rest * 1000 // whole
        rest = rest * 1000 % whole
    return out + 1


def distance(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], of_a: int, of_b: int, kept: int, terms: int) -> int:
    """Sum of the differences of two groups' shares over ``terms`` terms, given the (numbers, counts) that each has."""
    if not terms:
        return 0
    none = np.zeros(1, np.int64)
    p, q = price(a[1], of_a, kept), price(b[1], of_b, kept)
    p0, q0 = int(price(none, of_a, kept)[0]), int(price(none, of_b, kept)[0])
    few_, many, swapped = (a[0], b[0], False) if len(a[0]) <= len(b[0]) else (b[0], a[0], True)
    at = gallop(few_, many)
    met = at < len(many)
    met[met] = many[at[met]] == few_[met]
    i, j = (np.flatnonzero(met), at[met]) if not swapped else (at[met], np.flatnonzero(met))
    own, other = np.ones(len(p), bool), np.ones(len(q), bool)
    own[i] = other[j] = False
    both = np.abs(p[i] - q[j]).sum()
    return int(both + np.abs(p[own] - q0).sum() + np.abs(q[other] - p0).sum()) + (terms - len(p) - len(q) + len(i)) * abs(p0 - q0)


def share(count: Column, total: Column, kept: Column) -> Column:
    """As ``price``, of columns."""
    return (F.expr("1L") + F.call_function("div", (count.cast("decimal(20,0)") + ADDED) * F.lit(UNITS).cast("decimal(10,0)"), (total + ADDED * kept).cast("decimal(20,0)"))).cast("long")


def source_audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, bucket: int = BUCKET) -> DataFrame:
    """lang, source, part, item, value, rank: distances of a source to the others of its language, and its most overused terms.

    Null text, lang and source count as ''.  Every row is a document, so repeated rows count as often
    as they are there; doc_id isn't read, other columns are ignored whatever their names.  A group
    without kept terms is compared like any other; where a language keeps no term all distances are
    0.  A source that is alone in its language has no rows of part ``pair``.  Equal values rank by
    item.  An empty table gives no rows.  Totals up to 9e15 words a group are exact.
    """
    counted = stored(term_counts(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-counts")
    groups = counted.where("term is null").select("lang", "source")
    total = counted.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).drop("docs")
    total = stored(total, "kept-terms")
    langs = few(stored(total.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("lang_n").alias("lang_total")).withColumn("buckets", F.ceil(F.col("kept") / bucket)), "audit-langs"))
    numbered = total.join(langs, "lang").withColumn("bucket", F.pmod(F.xxhash64("term"), F.col("buckets")).cast("int"))
    numbered = numbered.withColumn("number", F.row_number().over(Window.partitionBy("lang", "bucket").orderBy("term")))
    cells = stored(counted.join(numbered, ["lang", "term"]).select("lang", "source", "term", "n", "bucket", "number", "lang_n"), "term-cells")
    totals = groups.join(cells.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(langs, "lang", "left")
    totals = few(stored(totals.select("lang", "source", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("total", "kept", "lang_total", "buckets"))), "audit-groups"))
    return pairs(cells, totals).unionByName(overused(cells, totals, top))


def pairs(cells: DataFrame, totals: DataFrame) -> DataFrame:
    arrays = cells.groupBy("lang", "bucket", "source").agg(F.sort_array(F.collect_list(F.struct("number", "n"))).alias("x"))
    arrays = stored(arrays.select("lang", "bucket", "source", F.col("x.number").alias("numbers"), F.col("x.n").alias("counts")), "term-arrays")
    sizes = cells.select("lang", "bucket", "number").groupBy("lang", "bucket").agg(F.max("number").alias("terms"))
    # the names of the pairs that the result lists
    a = totals.select("lang", F.col("source").alias("a"), F.col("total").alias("of_a"), "kept", F.explode(F.sequence(F.lit(0), F.greatest("buckets", F.lit(1)).cast("int") - 1)).alias("bucket"))
    b = totals.select("lang", F.col("source").alias("b"), F.col("total").alias("of_b"))
    tasks = a.join(b, "lang").where("a < b").join(sizes, ["lang", "bucket"], "left")
    one, two = (arrays.withColumnRenamed("source", s) for s in ("a", "b"))
    key = ("lang", "a", "b", "bucket")
    left = tasks.join(one, ["lang", "bucket", "a"], "left").select(*key, "of_a", "of_b", "kept", F.coalesce("terms", F.lit(0)).alias("terms"), "numbers", "counts")
    # columns of its own, as both sides come from the same tables
    right = tasks.join(two, ["lang", "bucket", "b"]).select(*(F.col(c).alias(f"r_{c}") for c in key), *(F.col(c).alias(c) for c in ("numbers", "counts")))

    def side(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        if not t.num_rows or not t.column("numbers")[0].is_valid:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.asarray(t.column(c).combine_chunks().flatten(), np.int64) for c in ("numbers", "counts"))  # type: ignore[return-value]

    def step(of: tuple, x: pa.Table, y: pa.Table) -> pa.Table:
        lang, a, b = (k.as_py() for k in of[:3])
        of_a, of_b, kept, terms = (x.column(c)[0].as_py() for c in ("of_a", "of_b", "kept", "terms"))
        value = distance(side(x), side(y), of_a, of_b, kept, terms)
        return pa.table({"lang": [lang, lang], "source": [a, b], "item": [b, a], "value": pa.array([value, value], pa.int64())})

    priced = left.groupBy(*key).cogroup(right.groupBy(*(f"r_{c}" for c in key))).applyInArrow(step, "lang string, source string, item string, value long")
    return ranked(priced.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")), "pair")


def overused(cells: DataFrame, totals: DataFrame, top: int) -> DataFrame:
    priced = cells.join(totals, ["lang", "source"]).select(
        "lang", "source", F.col("term").alias("item"), (share(F.col("n"), F.col("total"), F.col("kept")) - share(F.col("lang_n"), F.col("lang_total"), F.col("kept"))).alias("value")
    )
    return ranked(priced.where("value > 0"), "term", top)


def ranked(rows: DataFrame, part: str, most: int | None = None) -> DataFrame:
    out = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    return (out if most is None else out.where(F.col("rank") <= most)).select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")


ORACLE = rf"""with d as (select row_number() over () r, coalesce(lang, '') lang, coalesce(source, '') source, coalesce(text, '') txt from documents),
    g as (select distinct lang, source from d),
    w as (select r, lang, source, translate(unnest(regexp_extract_all(txt, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') term from d),
    k as (select lang, term, count(*) lang_n from w group by all having count(distinct r) >= {LEAST_DOCS}),
    v as (select lang, count(*) kept, cast(sum(lang_n) as bigint) lang_total from k group by lang),
    c as (select w.lang, w.source, w.term, count(*) n from w join k on k.lang = w.lang and k.term = w.term group by all),
    t as (select g.lang, g.source, coalesce(cast(sum(c.n) as bigint), 0) total from g left join c on c.lang = g.lang and c.source = g.source group by all),
    p as (select t.lang, t.source, k.term, coalesce(c.n, 0) n, 1 + {UNITS} * (coalesce(c.n, 0) + {ADDED}) // (t.total + {ADDED} * v.kept) p, 1 + {UNITS} * (k.lang_n + {ADDED}) // (v.lang_total + {ADDED} * v.kept) q
        from t join k on k.lang = t.lang join v on v.lang = t.lang left join c on c.lang = t.lang and c.source = t.source and c.term = k.term),
    f as (select a.lang, a.source, b.source item, cast(sum(abs(a.p - b.p)) as bigint) x from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
    pr as (select a.lang, a.source, b.source item, coalesce(f.x, 0) x from g a join g b on a.lang = b.lang and a.source <> b.source left join f on f.lang = a.lang and f.source = a.source and f.item = b.source)
    select lang, source, 'pair' part, item, x "value", cast(row_number() over (partition by lang, source order by x desc, item) as integer) rank from pr
    union all select * from (select lang, source, 'term', term, p - q, cast(row_number() over (partition by lang, source order by p - q desc, term) as integer) rank from p where n > 0 and p > q) where rank <= {TOP}"""
