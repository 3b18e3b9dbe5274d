"""Registered queries of the capture engine and their SQL equivalents."""

from __future__ import annotations

import gzip
from collections.abc import Callable, Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import derived, sinks
from .api import Archive
from .functions import fields
from .functions.urls import surt
from .operators import budget, discover, payload, reduce
from .operators.sampling import Sampling, sample
from .plans.query import Collapse, Language, Mime, Status, Tld, UrlQuery, UrlRegex
from .plans.template import UrlTemplate
from .session import scratch, stored
from .sources import captures as src
from .streaming import captures as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

KEY = ("crawl", "urlkey", "url", "timestamp", "status", "digest", "offset")
_KEY = 'crawl, urlkey, url, timestamp, status, digest, "offset"'
_ORDER = 'crawl_ord, urlkey, timestamp, filename, "offset"'
_TIES = 'timestamp, crawl_ord, filename, "offset"'
_FROM, _TO = datetime(2024, 1, 5), datetime(2024, 1, 12, 12)


def register(name: str, sql: str | None = None, select: tuple[str, ...] | None = KEY) -> Callable[[Callable[[DataFrame, Archive], DataFrame]], Query]:
    """A query over the derived captures; ``sql`` follows the derivation's CTE."""

    def add(f: Callable[[DataFrame, Archive], DataFrame]) -> Query:
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            captures = derived.captures(spark, sf_dir)
            out = f(captures, Archive(spark, captures, derived.crawls(spark)))
            return out.select(*select) if select else out

        QUERIES[name] = query
        if sql:
            ORACLES[name] = derived.CTE + sql
        return query

    return add


def over_pages(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def searched(name: str, query: UrlQuery, where: str) -> None:
    register(name, f"select {_KEY} from captures where {where}")(lambda c, a: a.search(query))


ALL = UrlQuery.domain("example.com")
_ALL = "(urlkey like 'com,example)%' or urlkey like 'com,example,%')"
searched("match_exact", UrlQuery.exact("https://www.therha.example.com/en/676"), "urlkey = 'com,example,therha)/en/676'")
searched("match_prefix", UrlQuery.prefix("therha.example.com/en/"), "starts_with(urlkey, 'com,example,therha)/en/')")
searched("match_host", UrlQuery.host("m.ththth.example.net"), "starts_with(urlkey, 'net,example,ththth,m)')")
searched("match_domain", ALL, _ALL)
searched("filter_status_eq", ALL.status(200), f"{_ALL} and status = 200")
searched("filter_status_in", ALL.status(301, 404), f"{_ALL} and status in (301, 404)")
searched("filter_status_class", ALL.status_class(4), f"{_ALL} and status between 400 and 499")
searched("filter_mime", ALL.where(Mime("application/pdf")), f"{_ALL} and (coalesce(mime, '') = 'application/pdf' or mime_detected = 'application/pdf')")
searched("filter_language", ALL.where(Language("eng")), f"{_ALL} and list_contains(string_split(languages_csv, ','), 'eng')")
searched("filter_url_regex", ALL.where(UrlRegex(r"[?&]page=\d+")), rf"{_ALL} and regexp_matches(url, '[?&]page=\d+')")
searched("filter_time_range", ALL.between(_FROM, _TO), f"{_ALL} and timestamp between timestamp '{_FROM}' and timestamp '{_TO}'")
searched(
    "filter_combined",
    ALL.where(Status(hundred=2), Mime("text/html"), Language("eng"), UrlRegex("/en/")).between(_FROM, _TO),
    f"{_ALL} and status between 200 and 299 and (coalesce(mime, '') = 'text/html' or mime_detected = 'text/html') "
    f"and list_contains(string_split(languages_csv, ','), 'eng') and regexp_matches(url, '/en/') and timestamp between timestamp '{_FROM}' and timestamp '{_TO}'",
)
searched("crawl_latest", ALL.in_crawls("latest"), f"{_ALL} and crawl = 'CC-MAIN-2024-04'")
searched("crawl_latest_n", ALL.in_crawls("latest-2"), f"{_ALL} and crawl_ord < 2")
searched("crawl_ids", ALL.in_crawls("CC-MAIN-2024-01,CC-MAIN-2024-03,CC-MAIN-1999-01"), f"{_ALL} and crawl in ('CC-MAIN-2024-01', 'CC-MAIN-2024-03')")
searched("crawl_year_range", ALL.in_crawls("2023..2025"), f"{_ALL} and crawl like 'CC-MAIN-2024-%'")
searched("crawl_since", ALL.in_crawls("since:2024-01-20"), f"{_ALL} and crawl in ('CC-MAIN-2024-03', 'CC-MAIN-2024-04')")


@register("filter_tld", f"select {_KEY} from captures where starts_with(urlkey, 'net,')")
def _tld(c: DataFrame, a: Archive) -> DataFrame:
    from .plans.compile import filter_predicate

    return c.where(filter_predicate(Tld("net")))


@register("project_fields", f"select urlkey, timestamp, status, mime_detected from captures where {_ALL}", None)
def _project(c: DataFrame, a: Archive) -> DataFrame:
    return a.search(ALL.select("urlkey", "timestamp", "status", "mime_detected"))


@register(
    "derived_locators",
    """select url, concat('https://data.commoncrawl.org/', filename) warc_url, concat('bytes=', "offset", '-', "offset" + length - 1) range_header,
       concat(crawl, ':', filename, ':', "offset") capture_key from captures""",
    None,
)
def _locators(c: DataFrame, a: Archive) -> DataFrame:
    return c.select(
        "url",
        fields.warc_url(F.col("filename")).alias("warc_url"),
        fields.range_header(F.col("offset"), F.col("length")).alias("range_header"),
        fields.capture_key(F.col("crawl"), F.col("filename"), F.col("offset")).alias("capture_key"),
    )


@register("challenge_flag", "select url, status, status in (403, 429, 503) or contains(lower(url), 'challenge') or contains(lower(url), '/cdn-cgi/') or contains(lower(url), '__cf_chl') challenge from captures", None)
def _challenge(c: DataFrame, a: Archive) -> DataFrame:
    return c.select("url", "status", fields.looks_like_challenge(F.col("status"), F.col("url")).alias("challenge"))


@over_pages("surt_keys", derived.CTE.replace("from events e cross join np join pages p on p.page_id = e.event_id % np.n", "from (select 0 event_id, timestamp '2024-01-01' ts, 1 user_id, 'view' event_type) e cross join pages p") + "select url, urlkey from captures")
def surt_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("url", surt(F.col("url")).alias("urlkey"))


def _first_per(key: str, order: str = _ORDER, where: str = "true") -> str:
    return f"select {_KEY} from (select *, row_number() over (partition by {key} order by {order}) rn from captures where {where}) where rn = 1"


register("distinct_urls", _first_per("urlkey"))(lambda c, a: reduce.distinct_urls(c))
register("collapse_digest", _first_per("digest"))(lambda c, a: reduce.collapse(c, Collapse("digest")))
register("collapse_urlkey", _first_per("urlkey"))(lambda c, a: reduce.collapse(c, Collapse("urlkey")))
register("collapse_timestamp", _first_per("urlkey, strftime(timestamp, '%Y%m%d')"))(lambda c, a: reduce.collapse(c, Collapse("timestamp", 8)))
register(
    "collapse_adjacent",
    f"select {_KEY} from (select *, lag(digest) over w p, row_number() over w rn from captures window w as (partition by urlkey order by {_TIES})) where rn = 1 or digest is distinct from p",
)(lambda c, a: reduce.collapse(c, Collapse("digest", adjacent=True)))
register("newest", f"select {_KEY} from captures order by timestamp desc, {_ORDER} limit 1")(lambda c, a: reduce.newest(c))
register("oldest", f"select {_KEY} from captures order by timestamp, {_ORDER} limit 1")(lambda c, a: reduce.oldest(c))
register("newest_200_per_url", _first_per("urlkey", f"timestamp desc, {_ORDER}", "status = 200"))(lambda c, a: reduce.newest_ok_per_url(c))
register("limit_ordered", f"select {_KEY} from captures where {_ALL} order by {_ORDER} limit 100")(lambda c, a: a.search(ALL.take(100)))
register("limit_half", f"select {_KEY} from (select *, row_number() over (order by {_ORDER}) rn, count(*) over () n from captures) where rn <= n // 2")(lambda c, a: reduce.ordered_limit(c, c.count() // 2))
register("budget_records", f"select {_KEY} from captures where {_ALL} order by {_ORDER} limit 50")(lambda c, a: budget.within_records(a.search(ALL), 50))
register(
    "budget_bytes",
    f'select {_KEY} from (select *, sum(length) over (order by {_ORDER} rows unbounded preceding) run from captures where {_ALL}) where run <= 100000',
)(lambda c, a: budget.within_bytes(a.search(ALL), 100_000))
register("stats_by_crawl", "select crawl, count(*) captures, cast(sum(length) as bigint) bytes, count(distinct urlkey) urls from captures group by crawl", None)(lambda c, a: reduce.stats_by_crawl(c))
register(
    "resume_after",
    f"select {_KEY} from captures where crawl_ord > 1 or (crawl_ord = 1 and urlkey > 'net,example') ",
)(lambda c, a: reduce.resume_after(c, {"crawl_ord": 1, "urlkey": "net,example"}))

_CHANGES = f"""select * from (select *, row_number() over w rn, count(*) over (partition by urlkey) n, lag(digest) over w p from captures
    window w as (partition by urlkey order by {_TIES})) where rn = 1 or rn = n or digest is distinct from p"""
register("sample_all", f"select {_KEY} from captures")(lambda c, a: sample(c, Sampling("all")))
register("sample_unique_digest", _first_per("urlkey, digest", _TIES))(lambda c, a: sample(c, Sampling("unique-digest")))
register(
    "sample_first_last",
    f"select {_KEY} from (select *, row_number() over (partition by urlkey order by {_TIES}) rn, count(*) over (partition by urlkey) n from captures) where rn = 1 or rn = n",
)(lambda c, a: sample(c, Sampling("first-last")))
register("sample_first_last_digest", f"select {_KEY} from ({_CHANGES})")(lambda c, a: sample(c))
register(
    "sample_adaptive",
    f"""select {_KEY} from (select *, row_number() over (partition by urlkey order by {_TIES}) - 1 r, count(*) over (partition by urlkey) m from ({_CHANGES}) x) y
    where m <= 8 or exists (select 1 from range(0, 8) i(k) where (i.k * (m - 1)) // 7 = r)""",
)(lambda c, a: sample(c, Sampling("adaptive", 8)))


def _hot(c: DataFrame) -> DataFrame:
    """Every capture under one key."""
    return c.withColumn("urlkey", F.lit("com,example)/"))


_ONE = f"""select * from (select *, row_number() over w rn, count(*) over () n, lag(digest) over w p from captures
    window w as (order by {_TIES})) where rn = 1 or rn = n or digest is distinct from p"""
_HOT = _KEY.replace("urlkey", "'com,example)/' as urlkey")
register("sample_hot_changes", f"select {_HOT} from ({_ONE})")(lambda c, a: sample(_hot(c)))
register("sample_hot_ends", f"select {_HOT} from ({_ONE}) where rn = 1 or rn = n")(lambda c, a: sample(_hot(c), Sampling("first-last")))
register(
    "sample_hot_adaptive",
    f"""select {_HOT} from (select *, row_number() over (order by {_TIES}) - 1 r, count(*) over () m from ({_ONE}) x) y
    where m <= 500 or exists (select 1 from range(0, 500) i(k) where (i.k * (m - 1)) // 499 = r)""",
)(lambda c, a: sample(_hot(c), Sampling("adaptive", 500)))


@over_pages(
    "template_bind",
    r"""with t as (select url, regexp_replace(regexp_replace(url, '^.*?://', ''), '^www\.', '') s from pages)
    select url, regexp_extract(s, '^([^/]+)/([^/]+)/([\s\S]+)$', 1) host, regexp_extract(s, '^([^/]+)/([^/]+)/([\s\S]+)$', 2) lang,
    regexp_extract(s, '^([^/]+)/([^/]+)/([\s\S]+)$', 3) page from t where regexp_matches(s, '^([^/]+)/([^/]+)/([\s\S]+)$')""",
)
def template_bind(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound = spark.read.parquet(f"{sf_dir}/pages.parquet").select("url", UrlTemplate.parse("{host}/{lang}/{page}").bind(F.col("url")).alias("vars"))
    return bound.where("vars is not null").select("url", *(F.col("vars")[k].alias(k) for k in ("host", "lang", "page")))


@register("union_crawls", f"select {_KEY} from captures where crawl in ('CC-MAIN-2024-01', 'CC-MAIN-2024-04')")
def _union(c: DataFrame, a: Archive) -> DataFrame:
    return c.where("crawl = 'CC-MAIN-2024-04'").unionByName(c.where("crawl = 'CC-MAIN-2024-01'"))


@register(
    "ndjson_rows",
    """select concat('{"crawl":"', crawl, '","urlkey":', to_json(urlkey), ',"url":', to_json(url), ',"timestamp":"', strftime(timestamp, '%Y-%m-%dT%H:%M:%SZ'), '","status":', status,
       ',"mime":', coalesce(to_json(mime), 'null'), ',"mime_detected":', coalesce(to_json(mime_detected), 'null'),
       ',"languages":', case when languages_csv = '' then '[]' else concat('["', replace(languages_csv, ',', '","'), '"]') end, ',"digest":', to_json(digest),
       ',"length":', length, ',"offset":', "offset", ',"filename":', to_json(filename), ',"redirect":', coalesce(to_json(redirect), 'null'), ',"truncated":null}') as value from captures""",
    None,
)
def _ndjson(c: DataFrame, a: Archive) -> DataFrame:
    return sinks.ndjson(c)


_SECONDS = _KEY.replace("timestamp", "date_trunc('second', timestamp) as timestamp")


@register("manifest_round_trip", f"select {_SECONDS} from captures")
def _manifest(c: DataFrame, a: Archive) -> DataFrame:
    return src.parse_manifest(sinks.ndjson(c)).withColumn("timestamp", F.date_trunc("second", "timestamp").cast("timestamp_ntz"))


@register("csv_rows", "select concat_ws(',', crawl, strftime(timestamp, '%Y%m%d%H%M%S'), status, url, digest, filename, \"offset\", length) as value from captures", None)
def _csv(c: DataFrame, a: Archive) -> DataFrame:
    return sinks.csv_rows(c)


@register(
    "index_lines",
    f"select {_SECONDS} from captures",
)
def _lines(c: DataFrame, a: Archive) -> DataFrame:
    said = c.select(
        "crawl",
        F.to_json(
            F.struct(
                "urlkey", fields.stamp(F.col("timestamp")).alias("timestamp"), "url", "mime", F.col("mime_detected").alias("mime-detected"), F.col("status").cast("string").alias("status"), "digest",
                F.col("length").cast("string").alias("length"), F.col("offset").cast("string").alias("offset"), "filename", F.array_join("languages", ",").alias("languages"), "redirect",
            )
        ).alias("value"),
    )
    return src.parse_lines(said).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


_HOSTS = r"regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)"


@over_pages("robots_sitemaps", f"select distinct {_HOSTS} host, concat('https://', {_HOSTS}, '/sitemap.xml') sitemap from pages")
def robots_sitemaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1).alias("host")).distinct()
    bodies = hosts.select("host", F.concat(F.lit("User-agent: *\r\nDisallow: /x\r\nSITEMAP:  https://"), "host", F.lit("/sitemap.xml \r\nSitemap:\r\n")).alias("body"))
    return discover.robots_sitemaps(bodies)


@over_pages("sitemap_locs", f"select {_HOSTS} host, url loc from pages")
def sitemap_locs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1).alias("host"), F.replace(F.col("url"), F.lit("&"), F.lit("&amp;")).alias("u"))
    maps = pages.groupBy("host").agg(F.array_join(F.collect_list(F.concat(F.lit("<url><loc> "), "u", F.lit("\n</loc></url>"))), "").alias("inner"))
    return discover.sitemap_urls(maps.select("host", F.concat(F.lit("<urlset>"), "inner", F.lit("<loc>unclosed")).alias("body")))


@register("payload_dedup", 'select digest, count(*) captures from captures group by digest', None)
def _dedup(c: DataFrame, a: Archive) -> DataFrame:
    return payload.once_per_digest(c).select("digest", "captures")


# Fixed value: bytes that are no UTF-8, as images begin.
NO_TEXT = b"\xff\xd8\xff\x00"


def page_records(spark: SparkSession, sf_dir: str, binary: bool = False) -> DataFrame:
    """(page_id, raw): gzip records around page bodies; every third body is gzip-encoded, some answers are blocked.

    binary: bodies begin with bytes that aren't text.
    """

    def record(page: int, html: str | None) -> bytes:
        body = NO_TEXT * binary + (html or "").encode()
        status = {0: "403 Forbidden", 1: "503 Busy"}.get(page % 11, "200 OK")
        head = f"HTTP/1.1 {status}\r\nServer: {'cloudflare' if page % 5 == 0 else 'nginx'}\r\nContent-Type: text/html\r\n"
        if page % 3 == 0:
            head, body = head + "Content-Encoding: gzip\r\n", gzip.compress(body, 1, mtime=0)
        block = head.encode() + b"\r\n" + body
        return gzip.compress(f"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n", 1, mtime=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, raws in payload.by_bytes(map(record, *map(payload.values, batch.columns)), len):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(raws)), pa.array(raws, pa.binary())], names=["page_id", "raw"])

    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html").mapInArrow(run, "page_id long, raw binary")


@over_pages("warc_text", "select page_id, case page_id % 11 when 0 then 403 when 1 then 503 else 200 end status, html as text from pages")
def warc_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payload.decode_payloads(page_records(spark, sf_dir), strict=True).select("page_id", "http.status", "text")


@over_pages("challenge_payload", "select page_id, page_id % 11 in (0, 1) challenge from pages")
def challenge_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payload.decode_payloads(page_records(spark, sf_dir)).select("page_id", payload.is_challenge(F.col("http")).alias("challenge"))


def _streamed(spark: SparkSession, parts: list[DataFrame], step: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """The result of a streaming plan that is started, and stopped, once for each part of its input."""
    source, out, state = (scratch(spark, f"{name}-{x}") for x in ("in", "out", "state"))
    for part in parts:
        part.drop("truncated").write.mode("append").parquet(source)
        step(spark.readStream.schema(part.drop("truncated").schema).parquet(source)).writeStream.trigger(availableNow=True).option("checkpointLocation", state).start(out, format="parquet").awaitTermination()
    return spark.read.parquet(out)


def _by_month_half(captures: DataFrame) -> list[DataFrame]:
    early = F.col("timestamp") < F.lit(_TO)
    return [captures.where(early), captures.where(~early)]


@over_pages("stream_distinct", derived.CTE + "select distinct urlkey from captures")
def stream_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, _by_month_half(derived.captures(spark, sf_dir)), lambda s: streams.stream_distinct(s).select("urlkey"), "distinct")


def _shuffled(captures: DataFrame, triggers: int = 4) -> list[DataFrame]:
    """Captures by time of arrival, up to two days behind their own time."""
    arrival = F.unix_timestamp(F.col("timestamp").cast("timestamp")) + F.pmod(F.xxhash64("offset"), F.lit(2 * 86_400))
    span = F.floor((arrival - F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp"))) / (8 * 86_400))
    part = F.least(F.greatest(span, F.lit(0)), F.lit(triggers - 1))
    dealt = stored(captures.withColumn("s_part", part.cast("int")), "arrivals")
    return [dealt.where(F.col("s_part") == k).drop("s_part") for k in range(triggers)]


@over_pages(
    "stream_changes",
    derived.CTE + 'select urlkey, timestamp, digest, "offset" from (select *, lag(digest) over (partition by urlkey order by timestamp, filename, "offset") p, row_number() over (partition by urlkey order by timestamp, filename, "offset") rn from captures) where rn = 1 or digest <> p',
)
def stream_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of captures that arrive out of order, and an end behind which none waits."""
    captures = derived.captures(spark, sf_dir).select("urlkey", "timestamp", "filename", "offset", "digest")
    parts = _shuffled(captures)
    streams.keep_state_on_disk(spark)
    try:
        found = _streamed(spark, [*parts, streams.closing(captures, "3 days")], lambda s: streams.stream_changes(s, "3 days"), "changes")
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return found.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


_BEHIND = '"offset" % 7000 = 0 and timestamp < timestamp \'2024-01-10\''


@over_pages(
    "stream_sessions",
    derived.CTE.rstrip() + f""", s1 as (select *, lag(timestamp) over (partition by urlkey order by timestamp) p from captures where not ({_BEHIND})),
    s2 as (select *, sum(case when p is null or timestamp - p >= interval 12 hour then 1 else 0 end) over (partition by urlkey order by timestamp rows unbounded preceding) nth from s1)
    select urlkey, min(timestamp) "start", max(timestamp) + interval 12 hour stop, count(*) n, cast(sum(length) as bigint) bytes from s2 group by urlkey, nth
    having max(timestamp) + interval 12 hour <= (select max(timestamp) from captures) - interval 1 day""",
)
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits by key; rows that come behind the watermark change nothing."""
    c = derived.captures(spark, sf_dir)
    late = F.expr(_BEHIND.replace('"offset"', "offset"))
    parts = [*_by_month_half(c.where(~late)), c.where(late)]
    return _streamed(spark, parts, lambda s: streams.sessions(s, "12 hours", "1 day"), "sessions").withColumns({k: F.col(k).cast("timestamp_ntz") for k in ("start", "stop")})


from . import stored_queries  # noqa: E402, F401  registers the queries over written tables and files
