"""Registered queries over written indexes, archives, caches, sitemaps and streams, with their SQL equivalents."""

from __future__ import annotations

import gzip
from collections.abc import Iterator
from dataclasses import replace
from datetime import datetime

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import derived, sinks
from .api import Archive, Settings, locate
from .functions import fields
from .functions.urls import host, surt, tld
from .operators import budget, cache, discover, reduce
from .operators.budget import Budget
from .plans.compile import sql_text
from .plans.query import Collapse, Language, MatchType, Mime, Status, UrlQuery
from .plans.template import UrlTemplate
from .queries import NO_TEXT, _ALL, _FROM, _KEY, _ORDER, _TO, ALL, KEY, _by_month_half, _first_per, _streamed, over_pages, page_records, register
from .session import scratch, stored
from .sources import captures as src
from .sources import ranges
from .streaming import captures as streams

_indexes: dict[tuple[str, str], str] = {}


def index_root(spark: SparkSession, sf_dir: str) -> str:
    """A written index of the derived captures, once a session; a second subset holds every row under another status."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _indexes:
        # written twice, and each time run to draw ranges before: derived once
        root, rows = scratch(spark, "index"), stored(derived.captures(spark, sf_dir).drop("redirect", "truncated", "crawl_ord"), "index-captures")
        src.write_index(rows, root)
        src.write_index(rows.withColumn("status", F.lit(404)), root, "robotstxt")
        _indexes[key] = root
    return _indexes[key]


def over_index(name: str, query: UrlQuery, where: str) -> None:
    """A search of the written index."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = Archive.of_index(spark, index_root(spark, sf_dir), derived.crawls(spark)).search(query)
        return found.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz")).select(*KEY)

    over_pages(name, derived.CTE + f"select {_KEY} from captures where {where}")(run)


over_index("index_scan_domain", ALL, _ALL)
over_index("index_scan_prefix", UrlQuery.prefix("therha.example.com/en/"), "starts_with(urlkey, 'com,example,therha)/en/')")
over_index("index_scan_status", ALL.status(200, 301), f"{_ALL} and status in (200, 301)")
over_index("index_scan_time", ALL.between(_FROM, _TO).where(Mime("application/pdf")), f"{_ALL} and timestamp between timestamp '{_FROM}' and timestamp '{_TO}' and (coalesce(mime, '') = 'application/pdf' or mime_detected = 'application/pdf')")
over_index("index_scan_crawl", ALL.in_crawls("latest-2").where(Language("eng")), f"{_ALL} and crawl_ord < 2 and list_contains(string_split(languages_csv, ','), 'eng')")


@over_pages("index_scan_subset", derived.CTE + "select urlkey, 404 status from captures")
def index_scan_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.read_index(spark, index_root(spark, sf_dir), "robotstxt").select("urlkey", "status")


@over_pages("index_partitions", derived.CTE + "select distinct crawl from captures")
def index_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.read_index(spark, index_root(spark, sf_dir)).select("crawl").distinct()


def over_sql(name: str, query: UrlQuery, crawls: list[str] | None, sql: str) -> None:
    """The compiled SQL text, run."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        view = f"ccindex_{abs(hash(sf_dir))}"
        spark.read.parquet(f"{index_root(spark, sf_dir)}/{src.INDEX_PATH}").createOrReplaceTempView(view)
        made = spark.sql(sql_text(replace(query, fields=("url", "status", "digest", "offset")), crawls, view))
        return made.toDF("url", "status", "digest", "offset")

    over_pages(name, derived.CTE + sql)(run)


_FOUR = 'url, status, digest, "offset"'
over_sql("sql_text_domain", ALL.where(Status(hundred=4), Language("eng")), None, f"select {_FOUR} from captures where {_ALL} and status between 400 and 499 and list_contains(string_split(languages_csv, ','), 'eng')")
over_sql("sql_text_host", UrlQuery.host("www.therha.example.com"), None, f"select {_FOUR} from captures where starts_with(urlkey, 'com,example,therha)')")
over_sql("sql_text_prefix", UrlQuery.prefix("therha.example.com/en/").between(_FROM, _TO), ["CC-MAIN-2024-01", "CC-MAIN-2024-02"], f"select {_FOUR} from captures where starts_with(urlkey, 'com,example,therha)/en/') and crawl_ord > 1 and timestamp between timestamp '{_FROM}' and timestamp '{_TO}'")
over_sql("sql_text_collapse", ALL.collapsed(Collapse("digest")), None, f"select {_FOUR} from (select *, row_number() over (partition by digest order by {_ORDER}) rn from captures where {_ALL}) where rn = 1")
over_sql("sql_text_limit", ALL.status(200).take(40), None, f"select {_FOUR} from captures where {_ALL} and status = 200 order by {_ORDER} limit 40")


@over_pages("sql_text_no_crawl", "select cast(0 as bigint) n")
def sql_text_no_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An empty crawl selection selects nothing."""
    spark.read.parquet(f"{index_root(spark, sf_dir)}/{src.INDEX_PATH}").createOrReplaceTempView("ccindex_none")
    return spark.sql(sql_text(ALL, [], "ccindex_none")).agg(F.count(F.lit(1)).alias("n"))


@over_pages("page_probes", "select page_id, case page_id % 3 when 2 then 0 else page_id end pages from pages")
def page_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id").cast("string")
    body = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit(" "), n, F.lit("\n"))).when(F.col("page_id") % 3 == 1, F.concat(F.lit('{"pageSize": 5, "pages": '), n, F.lit("}"))).otherwise("busy")
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", fields.pages_of(body).alias("pages"))


@over_pages("url_hosts", r"select url, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)), '^www[.]', '') as host, regexp_extract(lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)), '([a-z]+)$', 1) as tld from pages")
def url_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("url", host(F.col("url")).alias("host"), tld(surt(F.col("url"))).alias("tld"))


@register("table_rows", "select concat(rpad(crawl, 16, ' '), ' ', rpad(strftime(timestamp, '%Y%m%d%H%M%S'), 14, ' '), ' ', lpad(cast(status as varchar), 3, ' '), '  ', url) as value from captures", None)
def _table(c: DataFrame, a: Archive) -> DataFrame:
    return sinks.table_rows(c)


@over_pages(
    "template_rows",
    r"""with t as (select url, regexp_replace(regexp_replace(url, '^.*?://', ''), '^www\.', '') s from pages)
    select concat('{"url":', to_json(url), ',"vars":{"host":', to_json(regexp_extract(s, '^([^/]+)/([\s\S]+)$', 1)), ',"path":', to_json(regexp_extract(s, '^([^/]+)/([\s\S]+)$', 2)), '}}') as value from t where regexp_matches(s, '^([^/]+)/([\s\S]+)$')""",
)
def template_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound = spark.read.parquet(f"{sf_dir}/pages.parquet").select("url", UrlTemplate.parse("{host}/{path}").bind(F.col("url")).alias("vars"))
    return sinks.template_rows(bound.where("vars is not null"))


@register(
    "enumerate_template",
    r"""select url, regexp_extract(s, '^([^/]+)/([^/]+)/([\s\S]+)$', 2) lang from (select *, regexp_replace(regexp_replace(url, '^.*?://', ''), '^www\.', '') s from captures)
    where regexp_matches(s, '^([^/]+)/([^/]+)/([\s\S]+)$') and crawl_ord = 0 and status = 200 and timestamp < timestamp '2024-01-28'""",
    None,
)
def _enumerate_template(c: DataFrame, a: Archive) -> DataFrame:
    """A template without a leading literal still keeps to crawls, filters and times."""
    found = a.enumerate_template("{host}/{lang}/{page}", "latest", (Status((200,)),), (datetime(2024, 1, 1), datetime(2024, 1, 27, 23, 59, 59, 999999)))
    return found.select("url", F.col("vars")["lang"].alias("lang"))


@register("enumerate_steps", f"select {_KEY} from ({_first_per('urlkey', _ORDER, f'{_ALL} and status = 200')}) x order by {_ORDER.replace('crawl_ord', 'crawl desc').replace('filename, ', '')} limit 30")
def _steps(c: DataFrame, a: Archive) -> DataFrame:
    return a.enumerate("example.com", MatchType.DOMAIN).status(200).distinct_urls().budget(Budget(records=30)).run()


@register("locate_captures", f"select {_KEY} from captures where crawl = 'CC-MAIN-2024-02' and \"offset\" % 50000 = 0", None)
def _locate(c: DataFrame, a: Archive) -> DataFrame:
    wanted = c.where("crawl = 'CC-MAIN-2024-02' and offset % 50000 = 0").select(fields.capture_key(F.col("crawl"), F.col("filename"), F.col("offset")).alias("k"))
    return locate(c, wanted, "k").select(*KEY)


@register("resume_token", f"select {_KEY} from captures where {_ALL} order by {_ORDER} offset 50")
def _resume(c: DataFrame, a: Archive) -> DataFrame:
    """What a record budget left, taken up by its token."""
    _, over = budget.spend(a.search(ALL), Budget(records=50))
    assert over is not None and over.resume
    return reduce.resume_after(a.search(ALL), over.resume)


@register("budget_both", f'select {_KEY} from (select *, sum(length) over (order by {_ORDER} rows unbounded preceding) run, row_number() over (order by {_ORDER}) rn from captures where {_ALL}) where run <= 60000 and rn <= 100')
def _both(c: DataFrame, a: Archive) -> DataFrame:
    return budget.spend(a.search(ALL), Budget(100, 60_000))[0]


# Cache tables


def _cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two entries a page: an index answer that expires and a payload that doesn't."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    ttl = F.when(F.col("page_id") % 2 == 0, 100).otherwise(0).cast("long")
    value = F.encode("url", "UTF-8")
    index = pages.select(F.lit("index").alias("domain"), F.col("page_id").cast("string").alias("key"), value.alias("value"), (F.col("page_id") * 10).cast("long").alias("written"), ttl.alias("ttl"))
    return index.union(index.select(F.lit("payload"), "key", "value", "written", F.lit(0).cast("long")))


_CACHE = """with c as (select 'index' as "domain", cast(page_id as varchar) as "key", encode(url) as "value", page_id * 10 as written, case when page_id % 2 = 0 then 100 else 0 end as ttl from pages
    union all select 'payload', cast(page_id as varchar), encode(url), page_id * 10, 0 from pages) """
_LIVE = "not (ttl > 0 and 1000 > written + ttl)"


@over_pages("cache_live", _CACHE + f"""select "key", decode("value") as url from c where "domain" = 'index' and {_LIVE} and cast("key" as integer) < 40""")
def cache_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = spark.range(40).select(F.col("id").cast("string").alias("key"))
    return cache.get(_cache(spark, sf_dir), "index", keys, F.lit(1000)).select("key", F.decode("value", "UTF-8").alias("url"))


@over_pages("cache_stats", _CACHE + """select "domain", count(*) entries, cast(sum(octet_length("value")) as bigint) bytes from c group by "domain" """)
def cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.stats(_cache(spark, sf_dir))


@over_pages("cache_collect", _CACHE + f"""select 'live' as what, cast(count(*) as bigint) n from c where {_LIVE} union all select 'reclaimed', cast(coalesce(sum(octet_length("value")), 0) as bigint) from c where not ({_LIVE})""")
def cache_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    live, reclaimed = cache.collect_garbage(_cache(spark, sf_dir), F.lit(1000))
    return live.agg(F.lit("live").alias("what"), F.count(F.lit(1)).alias("n")).union(reclaimed.select(F.lit("reclaimed"), F.col("reclaimed").cast("long")))


@over_pages("cache_store", _CACHE + """select "domain", "key", case when "domain" = 'payload' and cast("key" as integer) % 3 = 0 then 'new' else decode("value") end as said from c""")
def cache_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries written twice: the later one of a key counts."""
    store, rows = cache.CacheStore(spark, scratch(spark, "cache")), _cache(spark, sf_dir)
    store.put(rows)
    store.put(rows.where("domain = 'payload' and cast(key as int) % 3 = 0").withColumns({"value": F.encode(F.lit("new"), "UTF-8"), "written": F.lit(10**9).cast("long")}))
    return store.table().select("domain", "key", F.decode("value", "UTF-8").alias("said"))


@over_pages("cache_lookup", _CACHE + f"""select "key", case when cast("key" as integer) % 6 = 0 then 'new' else decode("value") end as url from c where "domain" = 'payload' and cast("key" as integer) % 3 = 0 and cast("key" as integer) % 5 <> 0""")
def cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some keys of a store that was written three times: replaced entries, and some taken out."""
    store, rows = cache.CacheStore(spark, scratch(spark, "cache")), _cache(spark, sf_dir)
    store.put(rows)
    number = F.col("key").cast("int")
    store.put(rows.where((F.col("domain") == "payload") & (number % 6 == 0)).withColumns({"value": F.encode(F.lit("new"), "UTF-8"), "written": F.lit(10**9).cast("long")}))
    store.remove("payload", rows.where((F.col("domain") == "payload") & (number % 5 == 0)).select("key"), F.lit(10**9 + 1))
    return store.get("payload", rows.where(number % 3 == 0).select("key"), F.lit(1000)).select("key", F.decode("value", "UTF-8").alias("url"))


@over_pages(
    "cache_store_gc",
    _CACHE + f"""select "domain" as what, cast(count(*) as bigint) n, cast(sum(octet_length("value")) as bigint) bytes from c where {_LIVE} group by "domain" union all
    select 'reclaimed', 0, cast(coalesce(sum(octet_length("value")), 0) as bigint) + (select count(*) * 3 from c where "domain" = 'payload' and cast("key" as integer) % 4 = 0) from c where not ({_LIVE})""",
)
def cache_store_gc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expired and replaced entries collected: what is left by domain, and the bytes that went."""
    store, rows = cache.CacheStore(spark, scratch(spark, "cache")), _cache(spark, sf_dir)
    store.put(rows.where("domain = 'payload' and cast(key as int) % 4 = 0").withColumns({"value": F.encode(F.lit("old"), "UTF-8"), "written": F.lit(-1).cast("long")}))
    store.put(rows)
    gone = store.collect_garbage(F.lit(1000))
    return store.stats().select(F.col("domain").alias("what"), F.col("entries").alias("n"), "bytes").union(gone.select(F.lit("reclaimed"), F.lit(0).cast("long"), "reclaimed"))


@over_pages("cache_layers", _CACHE + """select "domain", "key", case when cast("key" as integer) % 2 = 1 and "domain" = 'index' then 'fast' else decode("value") end as said, case when cast("key" as integer) % 2 = 1 and "domain" = 'index' then 7 else 0 end as ttl from c""")
def cache_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tier in memory before one on storage."""
    store = cache.CacheStore(spark, scratch(spark, "cache"))
    store.put(_cache(spark, sf_dir))
    fast = _cache(spark, sf_dir).where("domain = 'index' and cast(key as int) % 2 = 1").withColumns({"value": F.encode(F.lit("fast"), "UTF-8"), "ttl": F.lit(7).cast("long")})
    return cache.layered(fast, store.table()).select("domain", "key", F.decode("value", "UTF-8").alias("said"), "ttl")


# Archived payloads


def archived(spark: SparkSession, sf_dir: str, binary: bool = False) -> tuple[str, DataFrame]:
    """(folder of archive files, locators): page records one behind another, a file for each task."""
    root = scratch(spark, "archives")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, base = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
        store.create_dir(base, recursive=True)
        name, at = f"seg-{TaskContext.get().partitionId()}.warc.gz", 0
        with store.open_output_stream(f"{base}/{name}", compression=None) as f:
            for batch in batches:
                sizes = [len(x.as_py()) for x in batch.column(1)]
                for x in batch.column(1):
                    f.write(x.as_py())
                offsets = [at + sum(sizes[:k]) for k in range(len(sizes))]
                at += sum(sizes)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([name] * len(sizes)), pa.array(offsets, pa.int64()), pa.array(sizes, pa.int64())], names=["page_id", "filename", "offset", "length"])

    rows = page_records(spark, sf_dir, binary).mapInArrow(write, "page_id long, filename string, offset long, length long")
    return root, stored(rows, "locators")


def _page_captures(spark: SparkSession, sf_dir: str, locators: DataFrame) -> DataFrame:
    """Two captures of every page that share its payload, and one whose archive is gone."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url").join(locators.hint("merge"), "page_id")
    at = F.timestamp_seconds(F.lit(1706400000) + F.col("page_id")).cast("timestamp_ntz")
    rows = pages.select(
        F.explode(F.array(F.lit("CC-MAIN-2024-04"), F.lit("CC-MAIN-2024-03"))).alias("crawl"), surt(F.col("url")).alias("urlkey"), "url", at.alias("timestamp"), F.lit(200).alias("status"), F.lit("text/html").alias("mime"),
        F.lit("text/html").alias("mime_detected"), F.array().cast("array<string>").alias("languages"), F.concat(F.lit("sha1:P"), F.col("page_id").cast("string")).alias("digest"), "length", "offset", "filename",
        F.lit(None).cast("string").alias("redirect"), F.lit(None).cast("string").alias("truncated"),
    )
    gone = rows.where("digest = 'sha1:P1' and crawl = 'CC-MAIN-2024-04'").withColumns({"digest": F.lit("sha1:gone"), "filename": F.lit("none.warc.gz")})
    return rows.unionByName(gone)


_FETCHED = "select c.crawl, p.url, concat('sha1:P', p.page_id) digest, case p.page_id % 11 when 0 then 403 when 1 then 503 else 200 end status_sent, cast(octet_length(encode(html)) as bigint) n_bytes, false failed from pages p, (values ('CC-MAIN-2024-04'), ('CC-MAIN-2024-03')) c(crawl) union all select 'CC-MAIN-2024-04', url, 'sha1:gone', -1, -1, true from pages where page_id = 1"


def _fetched(archive: Archive, captures: DataFrame) -> DataFrame:
    got = archive.fetch(captures)
    return got.select("crawl", "url", "digest", F.coalesce("http.status", F.lit(-1)).alias("status_sent"), F.coalesce(F.octet_length("text").cast("long"), F.lit(-1)).alias("n_bytes"), F.col("error").isNotNull().alias("failed"))


@over_pages("fetch_ranges", _FETCHED)
def fetch_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte ranges of archive files; what is missing is a row with an error."""
    root, locators = archived(spark, sf_dir)
    captures = _page_captures(spark, sf_dir, locators)
    return _fetched(Archive(spark, captures, derived.crawls(spark), settings=Settings(archives=root)), captures)


@over_pages("fetch_cached", _FETCHED)
def fetch_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second fetch finds in the cache what the first one read, though the archives are gone."""
    root, locators = archived(spark, sf_dir)
    captures, store = _page_captures(spark, sf_dir, locators), scratch(spark, "payload-cache")
    Archive(spark, captures, derived.crawls(spark), settings=Settings(archives=root, cache=store)).raw_payloads(captures)
    return _fetched(Archive(spark, captures, derived.crawls(spark), settings=Settings(archives=root + "-gone", cache=store)), captures)


@over_pages("fetch_payload_table", _FETCHED)
def fetch_payload_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads from a table, in which digests repeat."""
    _, locators = archived(spark, sf_dir)
    captures = _page_captures(spark, sf_dir, locators)
    table = page_records(spark, sf_dir).select(F.concat(F.lit("sha1:P"), F.col("page_id").cast("string")).alias("digest"), "raw")
    return _fetched(Archive(spark, captures, derived.crawls(spark), table.union(table)), captures)


_BYTES = f"'{''.join(f'\\x{x:02X}' for x in NO_TEXT)}'::blob || encode(html)"


@over_pages("payload_files", f"select concat('sha1_P', page_id) as name, cast(octet_length({_BYTES}) as bigint) as bytes, sha256({_BYTES}) as sha256, false as failed from pages union all select 'sha1_gone', -1, null, true")
def payload_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for every distinct payload, zipped or not, and what the files hold."""
    root, locators = archived(spark, sf_dir, binary=True)
    captures, out = _page_captures(spark, sf_dir, locators), scratch(spark, "payload-out")
    written = Archive(spark, captures, derived.crawls(spark), settings=Settings(archives=root)).write_payloads(captures, out)
    files = spark.read.format("binaryFile").load(out).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"))
    return written.join(files, "name", "left").select("name", F.coalesce("bytes", F.lit(-1)).alias("bytes"), "sha256", F.col("error").isNotNull().alias("failed"))


@over_pages("fetch_bodies", f"select c.crawl, p.url, sha256({_BYTES}) as sha256 from pages p, (values ('CC-MAIN-2024-04'), ('CC-MAIN-2024-03')) c(crawl) union all select 'CC-MAIN-2024-04', url, null from pages where page_id = 1")
def fetch_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies as bytes, whatever they are, no byte more than was sent."""
    root, locators = archived(spark, sf_dir, binary=True)
    captures = _page_captures(spark, sf_dir, locators)
    got = Archive(spark, captures, derived.crawls(spark), settings=Settings(archives=root)).fetch_http(captures)
    return got.select("crawl", "url", F.sha2("body", 256).alias("sha256"))


_GAP, _SLAB, _TASK = 4000, 100_000, 20_000


@over_pages(
    "read_plan",
    derived.CTE.rstrip() + f""", l as (select digest, filename, "offset" o, "offset" + length e, "offset" // {_SLAB} s, length from captures),
    l2 as (select *, max(e) over (partition by filename, s order by o, length, digest rows between unbounded preceding and 1 preceding) be from l),
    l3 as (select *, case when be is null or o > be + {_GAP} then 1 else 0 end nw from l2),
    l4 as (select *, sum(nw) over (partition by filename, s order by o, length, digest rows unbounded preceding) nth from l3),
    rd as (select filename, s, nth, min(o) "start", max(e) stop, count(*) ranges from l4 group by all),
    sl as (select filename, s, sum(stop - "start") bytes from rd group by all),
    t as (select filename, s, (sum(bytes) over (order by filename, s rows unbounded preceding) - bytes) // {_TASK} task from sl)
    select rd.filename, "start", stop, ranges, cast(task as integer) task from rd join t on t.filename = rd.filename and t.s = rd.s""",
)
def read_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads that the ranges of all captures become, and the tasks that they are dealt to by bytes."""
    planned, _ = ranges.packed(ranges.reads(derived.captures(spark, sf_dir).select("digest", "filename", "offset", "length"), _GAP, _SLAB), _TASK)
    return planned.groupBy("filename", F.col("r_start").alias("start"), F.col("r_stop").alias("stop"), F.col("r_task").alias("task")).agg(F.count(F.lit(1)).alias("ranges"))


@over_pages("newest_text", "select url, md5(html) as said from pages where page_id % 3 = 0 and page_id % 11 > 1 and page_id < 100")
def newest_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, locators = archived(spark, sf_dir)
    archive = Archive(spark, _page_captures(spark, sf_dir, locators), derived.crawls(spark), settings=Settings(archives=root))
    urls = spark.read.parquet(f"{sf_dir}/pages.parquet").where("page_id % 3 = 0 and page_id % 11 > 1 and page_id < 100").select("url")
    return archive.text(urls).select("url", F.md5("text").alias("said"))


_HOSTS = r"regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)"


@over_pages("sitemap_seeds", f"select distinct url from pages union select distinct concat('https://', {_HOSTS}, '/sitemap.xml') from pages")
def sitemap_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Robots files to sitemaps to addresses, each once and sorted."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1).alias("host"), F.replace(F.col("url"), F.lit("&"), F.lit("&amp;")).alias("u"))
    robots = pages.select(F.concat(F.lit("Sitemap: https://"), "host", F.lit("/sitemap.xml\n")).alias("body"))
    maps = pages.select(F.concat(F.lit("<loc>"), "u", F.lit("</loc>")).alias("body"))
    return discover.seeds(discover.robots_sitemaps(robots), discover.sitemap_urls(maps))


# Sitemaps and sketches


def _site(spark: SparkSession, sf_dir: str) -> Archive:
    """An archived site whose sitemap indexes name each other, zipped maps, and each page: 500 a map."""
    base = "https://maps.example.org"
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    part = F.floor(F.col("page_id") / 500)
    loc = lambda c: F.concat(F.lit("<loc>"), F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("</loc>\n"))
    name = lambda k: F.concat(F.lit(f"{base}/part-"), k.cast("string"), F.when(k % 3 == 0, ".xml.gz").otherwise(".xml"))
    maps = pages.groupBy(part.alias("k")).agg(F.array_join(F.collect_list(loc(F.col("url"))), "").alias("inner")).select(name(F.col("k")).alias("url"), F.concat(F.lit("<urlset>"), "inner", F.lit("</urlset>")).alias("body"))
    # names of the maps, a 500th of the pages
    listed = pages.select(part.alias("k")).distinct().groupBy((F.col("k") % 2).alias("odd")).agg(F.array_join(F.collect_list(loc(name(F.col("k")))), "").alias("inner"))
    both = f"<loc>{base}/index.xml.gz</loc><loc>{base}/deep.xml</loc>"
    indexes = spark.createDataFrame([(0, f"{base}/index.xml.gz"), (1, f"{base}/deep.xml")], "n long, url string").join(listed, F.col("n") == F.col("odd"), "left")
    indexes = indexes.select("url", F.concat(F.lit(f"<sitemapindex>{both}"), F.coalesce("inner", F.lit("")), F.lit("</sitemapindex>")).alias("body"))
    robots = spark.createDataFrame([(f"{base}/robots.txt", f"Sitemap: {base}/index.xml.gz\n")], "url string, body string")

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = []
            for url, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                block = b"HTTP/1.1 200 OK\r\n\r\n" + (gzip.compress(body.encode(), 1, mtime=0) if url.endswith(".gz") else body.encode())
                raws.append(gzip.compress(f"WARC/1.0\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n", 1, mtime=0))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raws, pa.binary())], names=["digest", "raw"])

    payloads = stored(robots.union(indexes).union(maps).mapInArrow(records, "digest string, raw binary"), "site")
    none = F.lit(None).cast("string")
    captures = payloads.select(
        F.lit("CC-MAIN-2024-04").alias("crawl"), surt(F.col("digest")).alias("urlkey"), F.col("digest").alias("url"), F.lit(datetime(2024, 1, 28)).cast("timestamp_ntz").alias("timestamp"), F.lit(200).alias("status"), F.lit("text/xml").alias("mime"),
        F.lit("text/xml").alias("mime_detected"), F.array().cast("array<string>").alias("languages"), "digest", F.lit(1).cast("long").alias("length"), F.lit(0).cast("long").alias("offset"), F.lit("f").alias("filename"), none.alias("redirect"), none.alias("truncated"),
    )
    return Archive(spark, captures, derived.crawls(spark), payloads)


_PARTS = "select distinct concat('https://maps.example.org/part-', page_id // 500, case when (page_id // 500) % 3 = 0 then '.xml.gz' else '.xml' end) as url from pages"


@over_pages("sitemap_indexes", f"select distinct url from pages union select url from ({_PARTS}) union select * from (values ('https://maps.example.org/index.xml.gz'), ('https://maps.example.org/deep.xml'), ('https://maps.example.org/sitemap.xml')) v(url)")
def sitemap_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sitemap indexes of an archived site, followed until nothing is new."""
    return _site(spark, sf_dir).sitemap_seeds("maps.example.org", "all", nested=True)


@register("stats_sketched", """select crawl, count(*) captures, cast(sum(length) as bigint) bytes, true urls_close, true digests_close from captures group by crawl
    union all select 'all', count(*), cast(sum(length) as bigint), true, true from captures""", None)
def _sketched(c: DataFrame, a: Archive) -> DataFrame:
    """Distinct counts from stored sketches, a crawl each and united, held against exact ones."""
    kept = stored(reduce.crawl_sketches(c), "sketches")
    said = reduce.sketched_stats(kept).union(reduce.sketched_stats(kept.withColumn("crawl", F.lit("all"))))
    exact = c.select(F.explode(F.array("crawl", F.lit("all"))).alias("crawl"), "urlkey", "digest").groupBy("crawl").agg(F.countDistinct("urlkey").alias("u"), F.countDistinct("digest").alias("d"))
    close = lambda x, y: F.abs(F.col(x) - F.col(y)) <= F.col(y) * 0.05
    return said.join(exact, "crawl").select("crawl", "captures", "bytes", close("urls", "u").alias("urls_close"), close("digests", "d").alias("digests_close"))


# Streams


@over_pages("stream_index_lines", derived.CTE + 'select urlkey, url, status, digest, "offset" from captures where crawl_ord = 0')
def stream_index_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index pages as they arrive, in two triggers."""
    source, out, state = (scratch(spark, f"lines-{x}") for x in ("in", "out", "state"))
    c = derived.captures(spark, sf_dir).where("crawl_ord = 0")
    line = F.to_json(F.struct("urlkey", fields.stamp(F.col("timestamp")).alias("timestamp"), "url", F.col("status").cast("string").alias("status"), "digest", F.col("length").cast("string").alias("length"), F.col("offset").cast("string").alias("offset"), "filename"))
    for k in range(2):
        c.where(F.col("offset") / 1000 % 2 == k).select(line.alias("value")).write.mode("append").text(source)
        streams.stream_lines(spark, source, "CC-MAIN-2024-04").select("urlkey", "url", "status", "digest", "offset").writeStream.trigger(availableNow=True).option("checkpointLocation", state).start(out, format="parquet").awaitTermination()
    return spark.read.parquet(out)


@over_pages("stream_budget", derived.CTE + f"select {_KEY} from captures order by timestamp < timestamp '{_TO}' desc, {_ORDER} limit 5000")
def stream_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record budget over two triggers, the earlier part first."""
    source, out, state = (scratch(spark, f"within-{x}") for x in ("in", "out", "state"))
    for part in _by_month_half(derived.captures(spark, sf_dir).drop("truncated")):
        part.write.mode("append").parquet(source)
        streams.write_within_records(spark.readStream.schema(part.schema).parquet(source), 5000, out, state).awaitTermination()
    return spark.read.parquet(out).select(*KEY)


_THIRD = "case when timestamp < timestamp '2024-01-08' then 0 when timestamp < timestamp '2024-01-20' then 1 else 2 end"


@over_pages("stream_budget_bytes", derived.CTE + f"select {_KEY} from (select *, sum(length) over (order by {_THIRD}, {_ORDER} rows unbounded preceding) run from captures) where run <= (select sum(length) * 6 // 10 from captures)")
def stream_budget_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A byte budget over three triggers, spent in the second or third."""
    source, out, state = (scratch(spark, f"bytes-{x}") for x in ("in", "out", "state"))
    c = derived.captures(spark, sf_dir).drop("truncated")
    most = c.agg(F.sum("length")).first()[0] * 6 // 10
    for k in range(3):
        c.where(F.expr(_THIRD) == k).write.mode("append").parquet(source)
        streams.write_within(spark.readStream.schema(c.schema).parquet(source), Budget(bytes=most), out, state).awaitTermination()
    return spark.read.parquet(out).select(*KEY)


@over_pages("stream_windows", derived.CTE + "select time_bucket(interval 1 day, timestamp) as start, status, count(*) n from captures where time_bucket(interval 1 day, timestamp) + interval 1 day <= (select max(timestamp) - interval 1 hour from captures) group by all")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of windows that the watermark has passed."""
    counted = lambda s: streams.windowed_counts(s, "1 day").select(F.col("window.start").cast("timestamp_ntz").alias("start"), "status", F.col("count").alias("n"))
    return _streamed(spark, _by_month_half(derived.captures(spark, sf_dir)), counted, "windows")
