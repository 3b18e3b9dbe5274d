"""The archive facade and the fluent query."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce as fold

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sinks
from .errors import BudgetExhaustedError, ConfigError
from .functions.urls import surt
from .operators import budget as budgets
from .operators import discover, payload, reduce
from .operators.cache import CacheStore
from .operators.sampling import Sampling, sample
from .plans import compile as plan
from .plans.crawls import CrawlSelector, resolve, select_crawls
from .plans.query import Collapse, Filter, MatchType, UrlQuery
from .plans.template import UrlTemplate
from .schema import COLUMNS
from .session import few, stored
from .sources.captures import read_index, with_crawl_order, with_defaults
from .sources.paged import open_transport, page_counts, read_pages, requests_of
from .sources.ranges import read_ranges
from .transport import MAX_CONCURRENCY, MAX_RPS, Transport


def run_query(captures: DataFrame, query: UrlQuery, crawls: list[str] | None = None) -> DataFrame:
    """Filter, collapse, order and limit, project: one declarative plan."""
    out = with_defaults(captures.where(plan.predicate(query, crawls)))
    if query.collapse:
        out = reduce.collapse(out, query.collapse)
    if query.limit is not None:
        out = reduce.ordered_limit(out, query.limit)
    return out.select(*query.fields) if query.fields else out


@dataclass(frozen=True)
class Settings:
    """How an archive reaches what it doesn't hold.

    archives: path, URI or address before payload file names.  transport: for addresses of web
    servers; without one, files are opened.  cache: folder of the payload cache.  workers: tasks
    that send requests at most; they share the transport's rate.  agent, rps, concurrency: of live
    index requests.  registry_ttl: seconds that a cached crawl list counts.
    """

    archives: str | None = None
    transport: Transport | None = None
    cache: str | None = None
    workers: int = MAX_CONCURRENCY
    agent: str = ""
    rps: float = MAX_RPS
    concurrency: int = MAX_CONCURRENCY
    registry_ttl: int = 86_400
    answers: str | None = None  # fixed answers instead of live ones

    def source(self) -> dict[str, object]:
        return {"agent": self.agent, "rps": self.rps, "concurrency": self.concurrency, "workers": self.workers} | ({"answers": self.answers} if self.answers else {})

    def live(self) -> Transport:
        return self.transport or open_transport({k: str(v) for k, v in self.source().items()})


class Archive:
    """Captures with their registry.  ``payloads`` is a table (digest, raw) of archived records, where there is one."""

    def __init__(self, spark: SparkSession, captures: DataFrame, registry: DataFrame, payloads: DataFrame | None = None, settings: Settings | None = None) -> None:
        self.spark, self.registry, self.payloads, self.settings = spark, registry, payloads, settings or Settings()
        self.captures = captures if "crawl_ord" in captures.columns else with_crawl_order(captures, registry)

    @classmethod
    def of_index(cls, spark: SparkSession, root: str, registry: DataFrame, subset: str = "warc", **more: object) -> Archive:
        """Over the columnar index below ``root``."""
        return cls(spark, read_index(spark, root, subset), registry, **more)  # type: ignore[arg-type]

    def live(self, query: UrlQuery) -> DataFrame:
        """Captures of a query from the index servers of its crawls, page by page, too many pages refused."""
        found = read_pages(self.spark, query, self._servers(query), **self.settings.source())
        return run_query(with_crawl_order(found, self.registry), query)

    def _servers(self, query: UrlQuery) -> list[tuple[str, str]]:
        return [(r["id"], r["cdx-api"]) for r in self.crawls(query.crawls).collect()]

    def page_counts(self, query: UrlQuery) -> dict[str, int]:
        """Index pages that hold a query's answer, by crawl: one small request a crawl, no captures read."""
        probes = {c: f"{u}&showNumPages=true" for c, u in requests_of(query, self._servers(query)).items()}
        return page_counts(self.settings.live(), probes)

    def crawls(self, selector: CrawlSelector | str = "all") -> DataFrame:
        return select_crawls(self.registry, CrawlSelector.parse(selector) if isinstance(selector, str) else selector)

    def search(self, query: UrlQuery) -> DataFrame:
        return run_query(self.captures, query, None if query.crawls == CrawlSelector() else resolve(self.registry, query.crawls))

    def stats(self, query: UrlQuery) -> DataFrame:
        return reduce.stats_by_crawl(self.search(replace(query, fields=None)))

    def write_sketches(self, path: str) -> None:
        """Store a small row of counts and sketches for each crawl, from which ``sketched_stats`` answers."""
        reduce.crawl_sketches(self.captures).write.mode("overwrite").parquet(path)

    def sketched_stats(self, path: str, selector: CrawlSelector | str = "all", united: bool = False) -> DataFrame:
        """Captures, bytes and about how many URLs and contents each chosen crawl has, or all of them together; no capture is read."""
        rows = self.spark.read.parquet(path).join(self.crawls(selector).select(F.col("id").alias("crawl")), "crawl", "left_semi")
        return reduce.sketched_stats(rows.withColumn("crawl", F.lit("all")) if united else rows)

    def manifest(self, query: UrlQuery, how: Sampling | None = None) -> DataFrame:
        return sample(self.search(replace(query, fields=None)), how)

    def enumerate(self, pattern: str, match: MatchType = MatchType.PREFIX) -> Enumerate:
        return Enumerate(self, UrlQuery(pattern, match))

    def enumerate_template(self, template: UrlTemplate | str, selector: CrawlSelector | str = "all", filters: tuple[Filter, ...] = (), time_range: tuple | None = None) -> DataFrame:
        """(url, vars) of captures that the template binds; a leading literal that holds a whole host bounds the scan."""
        t = UrlTemplate.parse(template) if isinstance(template, str) else template
        chosen = CrawlSelector.parse(selector) if isinstance(selector, str) else selector
        query = UrlQuery(t.prefix or "", MatchType.PREFIX, chosen, tuple(filters), time_range=time_range)
        if "/" in t.prefix:
            found = self.search(query)
        else:
            found = self.captures
            for condition in plan.conditions(query, None if chosen == CrawlSelector() else resolve(self.registry, chosen)):
                found = found.where(condition)
        return found.select("url", t.bind(F.col("url")).alias("vars")).where("vars is not null")

    def newest(self, urls: DataFrame, selector: CrawlSelector | str = "all") -> DataFrame:
        """The newest capture with status 200 of each wanted ``url``."""
        chosen = CrawlSelector.parse(selector) if isinstance(selector, str) else selector
        rows = self.captures if chosen == CrawlSelector() else self.captures.where(F.col("crawl").isin(*(resolve(self.registry, chosen) or [""])))
        keys = urls.select(F.col("url").alias("wanted"), surt(F.col("url")).alias("urlkey")).distinct()
        return reduce.newest_ok_per_url(with_defaults(rows).join(keys.select("urlkey").distinct(), "urlkey", "left_semi")).join(keys, "urlkey")

    def raw_payloads(self, captures: DataFrame) -> DataFrame:
        """(digest, raw, error), one row a wanted digest: from the payload table, else the cache, else read from the archives and cached.

        Equal digests are read once, at their first (filename, offset).  Where nothing holds a
        payload, ``error`` says why and ``raw`` is null.  With a cache this runs reads and a write.
        """
        wanted = payload.once_per_digest(captures)
        found: list[DataFrame] = []
        if self.payloads is not None:
            held = self.payloads.join(wanted, "digest", "left_semi").select("digest", "raw")
            # only payloads whose digest repeats are grouped
            again = few(stored(held.groupBy("digest").count().where("count > 1").select("digest"), "repeated-digests"))
            table = held.join(again, "digest", "left_anti").unionByName(held.join(again, "digest", "left_semi").groupBy("digest").agg(F.min("raw").alias("raw")))
            found.append(table.select("digest", "raw", F.lit(None).cast("string").alias("error")))
            wanted = payload.missing(wanted, table)
        store = CacheStore(self.spark, self.settings.cache) if self.settings.cache else None
        if store:
            hit = store.get("payload", wanted.select(F.col("digest").alias("key")), F.unix_timestamp())
            hit = hit.select(F.col("key").alias("digest"), F.col("value").alias("raw"), F.lit(None).cast("string").alias("error"))
            found.append(hit)
            wanted = payload.missing(wanted, hit)
        if self.settings.archives is not None:
            read = read_ranges(self.settings.archives, wanted, self.settings.transport, self.settings.workers if self.settings.transport else None)
            if store:
                read = stored(read, "ranges")
                store.put(read.where("raw is not null").select(F.lit("payload").alias("domain"), F.col("digest").alias("key"), F.col("raw").alias("value"), F.unix_timestamp().alias("written"), F.lit(0).cast("long").alias("ttl")))
            found.append(read)
        else:
            found.append(wanted.select("digest", F.lit(None).cast("binary").alias("raw"), F.lit("no payload in any store").alias("error")))
        return fold(DataFrame.unionByName, found)

    def _decoded(self, captures: DataFrame, on_error: str, strict: bool, parts: tuple[str, ...]) -> DataFrame:
        """(digest, parts, error), one row a wanted digest."""
        if self.payloads is None and self.settings.archives is None and self.settings.cache is None:
            raise ConfigError("this archive has neither payload table nor archives nor cache")
        raw = self.raw_payloads(captures).withColumnRenamed("error", "read_error")
        if on_error == "raise":
            raw = raw.withColumn("raw", F.when(F.col("read_error").isNull(), F.col("raw")).otherwise(F.raise_error(F.col("read_error")).cast("binary")))
        made = payload.decode_payloads(raw, strict=strict, on_error=on_error, parts=parts)
        return made.withColumn("error", F.coalesce("read_error", "error")).drop("read_error")

    def fetch(self, captures: DataFrame, on_error: str = "null", strict: bool = True, parts: tuple[str, ...] = ("record", "http", "text")) -> DataFrame:
        """Captures with ``parts`` and error; each payload is read and decoded once however many captures share it.

        on_error: "null" keeps captures whose payload is missing or broken, with the error; "raise"
        fails.  strict: records end with their declared length; otherwise with their data, end marks
        included.  parts: of record, http, text and body (the decoded bytes).
        """
        # payloads are much larger than what their sizes are judged by, their locators: they must not be broadcast
        return captures.join(self._decoded(captures, on_error, strict, parts).hint("merge"), "digest", "left")

    def fetch_http(self, captures: DataFrame, strict: bool = True) -> DataFrame:
        """Captures with the status, headers and decoded body of their responses, as bytes, and the error where there is none."""
        return self.fetch(captures, strict=strict, parts=("http", "body")).select(*captures.columns, "http", "body", "error")

    def fetch_url(self, url: str, selector: CrawlSelector | str = "all") -> DataFrame:
        """The newest capture with status 200 of one URL, fetched; no row if there is none."""
        return self.fetch(self.newest(self.spark.createDataFrame([(url,)], "url string"), selector))

    def write_payloads(self, captures: DataFrame, root: str, strict: bool = True) -> DataFrame:
        """Write each distinct payload's decoded body as a file named by its digest; (name, bytes, error) of each."""
        bodies = self._decoded(captures, "null", strict, ("body",))
        return sinks.write_payload_files(sinks.payload_table(bodies), root)

    def text(self, urls: DataFrame, selector: CrawlSelector | str = "all") -> DataFrame:
        return self.fetch(self.newest(urls, selector)).select(F.col("wanted").alias("url"), "crawl", "timestamp", "text", "error")

    def sitemap_seeds(self, host: str, selector: CrawlSelector | str = "latest", nested: bool = False) -> DataFrame:
        """URLs of a host's archived sitemaps, and the sitemaps themselves, sorted; what isn't archived adds nothing.

        nested: what a sitemap index names is a sitemap too, and followed; zipped sitemaps are unzipped.
        """
        base = f"https://{host}"
        one = lambda rows: self.spark.createDataFrame([(r,) for r in rows], "url string")
        robots = self.text(one([f"{base}/robots.txt"]), selector)
        maps = robots.select(F.explode(discover.sitemap_lines(F.col("text"))).alias("sitemap")).union(one([f"{base}/sitemap.xml"])).distinct()
        if nested:
            bodies = lambda urls: self.fetch(self.newest(urls, selector), parts=("body",)).select(F.col("wanted").alias("url"), "body")
            return discover.seeds(*discover.follow(maps, lambda urls: payload.unzipped_texts(bodies(urls))))
        bodies = self.text(maps.select(F.col("sitemap").alias("url")), selector)
        return discover.seeds(maps, bodies.select(F.explode(discover.locations(F.col("text"))).alias("loc")))

    def dry_run(self, query: UrlQuery) -> list[str]:
        """The index requests, the SQL text and nothing run."""
        rows = self.crawls(query.crawls).collect()
        return [plan.index_url(r["cdx-api"] or f"https://index/{r['id']}-index", query) for r in rows] + [plan.sql_text(query, None if query.crawls == CrawlSelector() else [r["id"] for r in rows])]


class Enumerate:
    """A query built step by step."""

    def __init__(self, archive: Archive, query: UrlQuery, distinct: bool = False, limits: budgets.Budget | None = None, token: str | None = None) -> None:
        self.archive, self.query, self.distinct, self.limits, self.token = archive, query, distinct, limits, token

    def _with(self, **x: object) -> Enumerate:
        now = {"query": self.query, "distinct": self.distinct, "limits": self.limits, "token": self.token} | x
        return Enumerate(self.archive, **now)  # type: ignore[arg-type]

    def resume(self, token: str | None) -> Enumerate:
        """Go on behind the capture that a budget's resume token names."""
        return self._with(token=token)

    def _rows(self) -> DataFrame:
        out = self.archive.search(self.query)
        out = reduce.distinct_urls(out) if self.distinct else out
        return reduce.resume_after(out, self.token) if self.token else out

    def distinct_urls(self, on: bool = True) -> Enumerate:
        return self._with(distinct=on)

    def crawls(self, selector: CrawlSelector | str) -> Enumerate:
        return self._with(query=self.query.in_crawls(selector))

    def status(self, *codes: int) -> Enumerate:
        return self._with(query=self.query.status(*codes))

    def where(self, *filters: Filter) -> Enumerate:
        return self._with(query=self.query.where(*filters))

    def time_range(self, start: object, end: object) -> Enumerate:
        return self._with(query=self.query.between(start, end))  # type: ignore[arg-type]

    def collapse(self, how: Collapse) -> Enumerate:
        return self._with(query=self.query.collapsed(how))

    def budget(self, limits: budgets.Budget) -> Enumerate:
        return self._with(limits=limits)

    def run(self) -> DataFrame:
        """The plan; with a budget, rows within it (``run_all`` also says whether rows were left)."""
        out = self._rows()
        if self.limits and self.limits.records is not None:
            out = budgets.within_records(out, self.limits.records)
        if self.limits and self.limits.bytes is not None:
            out = budgets.within_bytes(out, self.limits.bytes)
        return out

    def run_all(self) -> tuple[DataFrame, BudgetExhaustedError | None]:
        """Rows within the budget, and the error to raise if rows were left; a page budget asks the index servers first."""
        limits = self.limits or budgets.Budget()
        pages = self.archive.page_counts(self.query) if limits.pages is not None else None
        return budgets.spend(self._rows(), limits, pages)


def locate(captures: DataFrame, keys: DataFrame, column: str = "key") -> DataFrame:
    """Captures that a table of capture keys names; the keys' parts join on crawl, file and offset."""
    k = F.col(column)
    crawl, rest = F.split_part(k, F.lit(":"), F.lit(1)), F.regexp_replace(k, "^[^:]*:", "")
    parts = keys.select(crawl.alias("crawl"), F.regexp_replace(rest, ":[0-9]+$", "").alias("filename"), F.regexp_extract(rest, ":([0-9]+)$", 1).try_cast("long").alias("offset")).distinct()
    return captures.join(parts, ["crawl", "filename", "offset"], "left_semi").select(*COLUMNS)
