"""What reads no table: registry, selectors, time expressions, back-off, requests, and index servers played by fixed answers."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
import pytest
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webstrata import derived, sinks
from webstrata.api import Archive, Settings
from webstrata.functions import fields, timespec
from webstrata.plans.crawls import CrawlSelector, crawl_year
from webstrata.plans.query import Collapse, UrlQuery
from webstrata.queries import _ALL, _FROM, _KEY, _TO, ALL, KEY
from webstrata.session import scratch
from webstrata.sources import captures as src
from webstrata.sources.paged import requests_of
from webstrata.transport import answer_name

from .conftest import rows_of

CASES = {}


def over_pages(name, sql):
    def add(f):
        CASES[name] = f, sql
        return f

    return add


_REGISTRY = ", ".join(f"('{i}', '{a}', {f"'{b}'" if b else 'null'}, {k})" for k, (i, a, b) in enumerate(derived.REGISTRY_ROWS))
_REGISTRY = f"(values {_REGISTRY}) r(id, \"from\", \"to\", crawl_ord)"


def _registry_file(spark: SparkSession) -> DataFrame:
    """The derived crawl list, written as the JSON array that index servers give, and read."""
    path = scratch(spark, "registry")
    rows = derived.crawls(spark).coalesce(1).orderBy("crawl_ord").select("id", F.col("id").alias("name"), F.lit("").alias("cdx-api"), "from", "to")
    rows.agg(F.to_json(F.collect_list(F.struct("*"))).alias("value")).coalesce(1).write.text(path)
    return src.read_registry(spark, path)


@over_pages("registry_scan", f'select id, "from", "to", cast(crawl_ord as integer) crawl_ord, cast(id[9:12] as integer) as year from {_REGISTRY}')
def registry_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _registry_file(spark).select("id", "from", "to", "crawl_ord", crawl_year(F.col("id")).alias("year"))


@over_pages("crawl_list", f"select concat(id, chr(9), id) as value from {_REGISTRY}")
def crawl_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.crawl_rows(_registry_file(spark))


_SELECTORS = ("all", "latest", "latest-3", "2023..2025", "2019..2021", "CC-MAIN-2024-02,CC-MAIN-2020-05", "since:2024-01-20")
_CHOSEN = {"all": "true", "latest": "crawl_ord = 0", "latest-3": "crawl_ord < 3", "2023..2025": "id like '%2024%'", "2019..2021": "id like '%2020%'", "CC-MAIN-2024-02,CC-MAIN-2020-05": "id in ('CC-MAIN-2024-02', 'CC-MAIN-2020-05')", "since:2024-01-20": "crawl_ord < 2"}


@over_pages("crawl_selectors", " union all ".join(f"select '{t}' as selector, id from {_REGISTRY} where {w}" for t, w in _CHOSEN.items()))
def crawl_selectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every form of selector, parsed, shown again and applied."""
    registry = derived.crawls(spark)
    parts = [registry.where(s.predicate()).select(F.lit(str(s)).alias("selector"), "id") for s in map(CrawlSelector.parse, _SELECTORS)]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


_NOW = datetime(2025, 3, 31, 9, 45, tzinfo=UTC)
_TIMES = {
    "now": "n", "today": "date_trunc('day', n)", "yesterday": "date_trunc('day', n) - interval 1 day", "5d": "n - interval 5 day", "2 weeks ago": "n - interval 14 day", "36 hours": "n - interval 36 hour", "1mo": "timestamp '2025-02-28 09:45:00'",
    "2 years ago": "n - interval 2 year", "2019": "timestamp '2019-01-01'", "2019-08": "timestamp '2019-08-01'", "20190817": "timestamp '2019-08-17'", "20190817010203": "timestamp '2019-08-17 01:02:03'", "2019-08-17T05:00:00+03:00": "timestamp '2019-08-17 02:00:00'",
}


@over_pages("time_expressions", "with t as (select timestamp '2025-03-31 09:45:00' n) " + " union all ".join(f"select '{t}' as said, {e} as at from t" for t, e in _TIMES.items()))
def time_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(t, timespec.parse(t, _NOW).replace(tzinfo=None)) for t in _TIMES], "said string, at timestamp_ntz")


@over_pages("backoff_schedule", "select cast(i as integer) attempt, cast(least(500 * pow(2, i), 30000) as bigint) ms from range(0, 10) t(i)")
def backoff_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    attempt = F.col("id").cast("int")
    return spark.range(10).select(attempt.alias("attempt"), fields.backoff_ms(attempt, 500, 30_000).alias("ms"))


def answered(spark: SparkSession, sf_dir: str, query: UrlQuery) -> str:
    """A folder of an index server's answers to one query: two pages a crawl that has captures, none of another."""
    root = scratch(spark, "answers")
    c = derived.captures(spark, sf_dir)
    line = F.to_json(F.struct("urlkey", fields.stamp(F.col("timestamp")).alias("timestamp"), "url", F.col("status").cast("string").alias("status"), "digest", F.col("length").cast("string").alias("length"), F.col("offset").cast("string").alias("offset"), "filename"))
    wanted = {crawl: url for crawl, url in requests_of(query, [(i, f"https://index.example.com/{i}") for i, _, _ in derived.REGISTRY_ROWS]).items()}
    pages = c.where(" or ".join(f"urlkey like '{x}%'" for x in ("com,example)", "com,example,"))).select("crawl", (F.col("offset") / 1000 % 2).cast("int").alias("page"), line.alias("line"))
    bodies = pages.groupBy("crawl", "page").agg(F.array_join(F.collect_list("line"), "\n").alias("body"))
    probes = pages.groupBy("crawl").agg(F.lit(-1).alias("page"), F.lit('{"pages": 2}').alias("body"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
        store.create_dir(base, recursive=True)
        for batch in batches:
            for crawl, page, body in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                with store.open_output_stream(f"{base}/{answer_name(wanted[crawl] + ('&showNumPages=true' if page < 0 else f'&page={page}'))}") as f:
                    f.write(body.encode())
            yield batch.select(["page"])

    bodies.select("crawl", "page", "body").union(probes.select("crawl", "page", "body")).mapInArrow(write, "page int").count()
    return root


def _served(spark: SparkSession, sf_dir: str) -> Archive:
    named = derived.crawls(spark).withColumn("cdx-api", F.concat(F.lit("https://index.example.com/"), "id"))
    return Archive(spark, derived.captures(spark, sf_dir).limit(0), named, settings=Settings(answers=answered(spark, sf_dir, ALL)))


@over_pages("paged_index", derived.CTE + f"select {_KEY.replace('timestamp', "date_trunc('second', timestamp) as timestamp")} from captures where {_ALL}")
def paged_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page of every crawl's index server."""
    return _served(spark, sf_dir).live(ALL).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz")).select(*KEY)


@over_pages("page_counts", derived.CTE + f"select crawl, cast(2 as bigint) pages from captures where {_ALL} group by crawl union all select 'CC-MAIN-2020-05', 0")
def page_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(list(_served(spark, sf_dir).page_counts(ALL).items()), "crawl string, pages long")


@over_pages("dry_run", f"""select concat('https://index.example.com/', id, '?url=example.com&matchType=domain&output=json&filter=status%3A200&collapse=digest&from=20240105000000&to=20240112120000&limit=9') as said from {_REGISTRY} where crawl_ord < 2""")
def dry_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = derived.crawls(spark).withColumn("cdx-api", F.concat(F.lit("https://index.example.com/"), "id"))
    query = ALL.status(200).collapsed(Collapse("digest")).between(_FROM, _TO).take(9).in_crawls("latest-2")
    said = Archive(spark, derived.captures(spark, sf_dir), named).dry_run(query)
    return spark.createDataFrame([(x,) for x in said if x.startswith("http")], "said string")


@pytest.mark.parametrize("name", sorted(CASES))
def test_case(spark, sf_dir, duck, name):
    query, sql = CASES[name]
    assert rows_of(query(spark, sf_dir).toPandas()) == rows_of(duck.sql(sql).df())
