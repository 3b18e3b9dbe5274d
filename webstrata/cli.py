"""Command line: ``python -m webstrata.cli <command>``."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sinks
from .api import Archive, Settings
from .errors import ArchiveError, ConfigError, NotFoundError, ParseError
from .functions.timespec import parse_range
from .operators import budget as budgets
from .operators import reduce
from .operators.cache import CacheStore
from .operators.sampling import Sampling, sample
from .plans.query import Collapse, MatchType, UrlQuery
from .schema import CAPTURE
from .session import session
from .sources import captures as src
from .sources.registry import live_registry
from .transport import MAX_RPS, HttpTransport, Politeness


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="webstrata")
    p.add_argument("--root", default=".", help="folder of the columnar index")
    p.add_argument("--registry", help="crawl list, JSON")
    p.add_argument("--payloads", help="payload table (digest, raw)")
    p.add_argument("--archives", help="path, URI or address before payload file names")
    p.add_argument("--cache", help="folder of the payload cache")
    p.add_argument("--agent", default="", help="user agent of live requests")
    p.add_argument("--rps", type=float, default=MAX_RPS)
    p.add_argument("--answers", help="folder of fixed answers instead of live requests")
    p.add_argument("--live", action="store_true", help="ask index servers instead of the columnar index")
    p.add_argument("--crawl", default="latest")
    p.add_argument("--from", dest="start")
    p.add_argument("--to", dest="end")
    p.add_argument("--output", default="ndjson")
    p.add_argument("--budget", type=int, help="most records")
    p.add_argument("--budget-bytes", type=int)
    p.add_argument("--budget-pages", type=int, help="most index pages of a crawl")
    p.add_argument("--resume", help="go on behind this capture, as a budget error names it")
    p.add_argument("--newest", action="store_true")
    p.add_argument("--oldest", action="store_true")
    p.add_argument("--dry-run", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("crawls").add_argument("--refresh", action="store_true", help="ask for the crawl list even if a cached one counts")
    for name in ("stats", "search", "manifest", "enumerate"):
        c = sub.add_parser(name)
        c.add_argument("pattern", nargs="?" if name == "enumerate" else None, default="")
        c.add_argument("--match", default="prefix")
        c.add_argument("--status", type=int, action="append", default=[])
        c.add_argument("--mime")
        c.add_argument("--language")
        c.add_argument("--tld")
        c.add_argument("--url-regex")
        c.add_argument("--limit", type=int)
        c.add_argument("--collapse")
        if name == "manifest":
            c.add_argument("--sample", default="first-last-digest")
        if name == "enumerate":
            c.add_argument("--distinct-urls", action="store_true")
            c.add_argument("--template")
            c.add_argument("--bulk", action="store_true", help="the columnar index, whatever --live says")
        if name == "stats":
            c.add_argument("--captures", action="store_true", help="count captures by crawl instead of index pages")
    for name in ("fetch", "text", "sitemap"):
        c = sub.add_parser(name)
        c.add_argument("target")
        if name == "fetch":
            c.add_argument("--out", help="folder for one file a payload")
            c.add_argument("--text", action="store_true")
    kept = sub.add_parser("cache")
    kept.add_argument("path")
    kept.add_argument("--gc", action="store_true", help="drop what has expired or was replaced, and say how many bytes that were")
    return p


def query_of(a: argparse.Namespace) -> UrlQuery:
    q = UrlQuery(a.pattern, MatchType.parse(a.match)).in_crawls(a.crawl)
    q = q.status(*a.status) if a.status else q
    for value, step in ((a.mime, "mime"), (a.language, "language"), (a.tld, "tld"), (a.url_regex, "url_regex")):
        q = getattr(q, step)(value) if value else q
    q = q.collapsed(Collapse.parse(a.collapse)) if a.collapse else q
    times = parse_range(a.start, a.end)
    q = q.between(*times) if times else q
    return q.take(a.limit) if a.limit is not None else q


def rendered(captures: DataFrame, form: str) -> Iterator[str]:
    """Lines of an output form; unknown forms are ndjson."""
    if form == "csv":
        yield ",".join(sinks.CSV_COLUMNS)
    made = {"csv": sinks.csv_rows, "table": sinks.table_rows}.get(form, sinks.ndjson)(captures)
    yield from (r["value"] for r in made.toLocalIterator())


def fetched(a: argparse.Namespace, archive: Archive) -> Iterator[str]:
    """Texts, bodies or written files of the wanted captures; raises after them if a payload failed."""
    spark = archive.spark
    if a.target.startswith("@"):
        lines = spark.createDataFrame([(x,) for x in sys.stdin], "value string") if a.target == "@-" else spark.read.text(a.target[1:])
        wanted = src.parse_manifest(lines)
    else:
        wanted = archive.newest(spark.createDataFrame([(a.target,)], "url string"), a.crawl)
        if wanted.isEmpty():
            raise NotFoundError(f"no capture of {a.target}")
    if a.command == "fetch" and a.out:
        rows = archive.write_payloads(wanted, a.out).select(F.concat_ws("\t", "name", F.col("bytes").cast("string")).alias("text"), "error")
    else:
        rows = archive.fetch(wanted).select("text", "error")
    failed = 0
    for r in rows.toLocalIterator():
        if r["error"] is None:
            yield r["text"]
        else:
            failed += 1
            print(f"error: {r['error']}", file=sys.stderr)
    if failed:
        raise ParseError(f"{failed} payloads failed")


def run(a: argparse.Namespace, archive: Archive) -> Iterator[str]:
    spark = archive.spark
    if a.command == "crawls":
        yield from (r["value"] for r in sinks.crawl_rows(archive.crawls(a.crawl)).collect())
        return
    if a.command == "cache":
        store = CacheStore(spark, a.path)
        said = store.collect_garbage(F.unix_timestamp()) if a.gc else store.stats().orderBy("domain")
        yield from (r["v"] for r in said.select(F.to_json(F.struct("*")).alias("v")).collect())
        return
    if a.command in ("fetch", "text"):
        yield from fetched(a, archive)
        return
    if a.command == "sitemap":
        yield from (r["url"] for r in archive.sitemap_seeds(a.target, a.crawl).toLocalIterator())
        return
    q = query_of(a)
    if a.dry_run:
        yield from archive.dry_run(q)
        return
    if a.command == "stats":
        if a.captures:
            yield from (r["v"] for r in archive.stats(q).orderBy("crawl").select(F.to_json(F.struct("*")).alias("v")).collect())
        else:
            yield json.dumps({"pages": sum(archive.page_counts(q).values())}, separators=(",", ":"))
        return
    if a.command == "enumerate" and a.template:
        bound = archive.enumerate_template(a.template, q.crawls, q.filters, q.time_range)
        yield from (r["value"] for r in sinks.template_rows(bound).toLocalIterator())
        return
    search = archive.live if a.live and not getattr(a, "bulk", False) else archive.search
    rows = sample(search(q), Sampling.parse(a.sample)) if a.command == "manifest" else search(q)
    if a.command == "enumerate" and a.distinct_urls:
        rows = reduce.distinct_urls(rows)
    if a.resume:
        rows = reduce.resume_after(rows, a.resume)
    pages = archive.page_counts(q) if a.budget_pages is not None else None
    rows, over = budgets.spend(rows, budgets.Budget(a.budget, a.budget_bytes, a.budget_pages), pages)
    if a.newest or a.oldest:
        rows = reduce.newest(rows) if a.newest else reduce.oldest(rows)
    yield from rendered(rows, a.output)
    if over:
        raise over


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        if not (a.registry or a.agent or a.answers):
            raise ConfigError("--registry, or an --agent to ask for it, is needed")
        spark = session()
        web = HttpTransport(a.agent, Politeness(a.rps)) if (a.archives or "").startswith(("http:", "https:")) else None
        settings = Settings(a.archives, web, a.cache, agent=a.agent, rps=a.rps, answers=a.answers)
        store = CacheStore(spark, a.cache) if a.cache else None
        registry = src.read_registry(spark, a.registry) if a.registry else live_registry(spark, settings.live(), store, settings.registry_ttl, getattr(a, "refresh", False))
        captures = spark.createDataFrame([], CAPTURE) if a.live or a.command == "crawls" else src.read_index(spark, a.root)
        archive = Archive(spark, captures, registry, spark.read.parquet(a.payloads) if a.payloads else None, settings)
        for line in run(a, archive):
            print(line)
    except ArchiveError as e:
        print(f"error: {e}", file=sys.stderr)
        return e.exit_code
    return 0


if __name__ == "__main__":
    sys.exit(main())
