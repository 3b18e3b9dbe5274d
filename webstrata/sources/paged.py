"""A live index server as a data source: one partition for each share of a crawl's pages.

    spark.dataSource.register(PagedIndex)
    spark.read.format("paged_index").options(**paged_options(query, crawls)).load()

The plan asks each crawl for its number of pages and refuses a crawl with too many before a page
is read.  At most ``workers`` tasks send requests, each at its share of the rate.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..errors import ConfigError
from ..operators.budget import MAX_PAGES, check_pages
from ..plans.compile import index_url
from ..plans.query import UrlQuery
from ..transport import FolderTransport, HttpTransport, MAX_CONCURRENCY, MAX_RPS, Politeness, Transport, lines_of, num_pages
from .captures import parse_lines


def open_transport(options: dict[str, str]) -> Transport:
    """``answers``: a folder of answers by URL; else HTTP with ``agent``, ``rps`` and ``concurrency``."""
    if options.get("answers"):
        return FolderTransport(options["answers"])
    if not options.get("agent"):
        raise ConfigError("a live index needs an agent that names you")
    return HttpTransport(options["agent"], Politeness(float(options.get("rps", MAX_RPS)), int(options.get("concurrency", MAX_CONCURRENCY))))


def page_counts(transport: Transport, probes: dict[str, str]) -> dict[str, int]:
    """Index pages by crawl, one small request each; a crawl that has nothing has 0."""
    return {crawl: num_pages(transport, url) for crawl, url in probes.items()}


def requests_of(query: UrlQuery, crawls: list[tuple[str, str]]) -> dict[str, str]:
    """Request of a query by crawl, from (id, address of its index)."""
    return {crawl: index_url(api or f"https://index.commoncrawl.org/{crawl}-index", query) for crawl, api in crawls}


def paged_options(query: UrlQuery, crawls: list[tuple[str, str]], max_pages: int = MAX_PAGES, workers: int = MAX_CONCURRENCY, **transport: object) -> dict[str, str]:
    return {"requests": json.dumps(requests_of(query, crawls)), "max_pages": str(max_pages), "workers": str(workers)} | {k: str(v) for k, v in transport.items()}


@dataclass
class Pages(InputPartition):
    """Requests of one task, in order."""

    urls: list[tuple[str, int, str]]  # crawl, page, address
    workers: int


class PagedIndex(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_index"

    def schema(self) -> str:
        return "crawl string, page int, value string"

    def reader(self, schema: object) -> DataSourceReader:
        return PagedReader(dict(self.options))


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options

    def partitions(self) -> list[Pages]:
        requests = json.loads(self.options["requests"])
        found = page_counts(open_transport(self.options), {c: f"{u}&showNumPages=true" for c, u in requests.items()})
        check_pages(found, int(self.options.get("max_pages", MAX_PAGES)))
        # page 0 is asked for even if the probe has no answer
        urls = [(c, n, f"{u}&page={n}") for c, u in requests.items() for n in range(max(1, found[c]))]
        workers = max(1, min(int(self.options.get("workers", MAX_CONCURRENCY)), len(urls)))
        return [Pages(urls[k::workers], workers) for k in range(workers) if urls[k::workers]]

    def read(self, partition: Pages) -> Iterator[pa.RecordBatch]:
        """A batch a page."""
        transport = open_transport(self.options)
        if isinstance(transport, HttpTransport):
            transport = transport.shared_by(partition.workers)
        for crawl, page, url in partition.urls:
            lines = list(lines_of(transport, url))
            if lines:
                yield pa.RecordBatch.from_arrays([pa.array([crawl] * len(lines)), pa.array([page] * len(lines), pa.int32()), pa.array(lines, pa.string())], names=["crawl", "page", "value"])


def read_pages(spark: SparkSession, query: UrlQuery, crawls: list[tuple[str, str]], mode: str = "FAILFAST", **options: object) -> DataFrame:
    """Captures that index servers answer a query with.  Filters were the servers' to apply; ``run_query`` applies them again."""
    spark.dataSource.register(PagedIndex)
    return parse_lines(spark.read.format("paged_index").options(**paged_options(query, crawls, **options)).load(), mode=mode)
