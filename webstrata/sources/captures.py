"""Sources of captures: index JSON lines, the partitioned columnar index, manifests, the registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fields import languages, parse_stamp
from ..functions.urls import host_name, tld
from ..schema import CAPTURE, COLUMNS

# Fixed value: layout of the columnar index.
INDEX_PATH = "cc-index/table/cc-main/warc"
_LINE = "urlkey string, timestamp string, url string, mime string, `mime-detected` string, status string, digest string, length string, offset string, filename string, languages string, redirect string, truncated string"
# Columns of the columnar index and what they become.
INDEX_COLUMNS = {
    "url_surtkey": "string", "url": "string", "fetch_time": "timestamp", "fetch_status": "int", "content_mime_type": "string", "content_mime_detected": "string",
    "content_languages": "string", "content_digest": "string", "warc_filename": "string", "warc_record_offset": "bigint", "warc_record_length": "bigint",
}


#: A registry of at most this many rows is broadcast.
BROADCAST_CRAWLS = 10_000


def parse_lines(lines: DataFrame, crawl: str | None = None, mode: str = "FAILFAST") -> DataFrame:
    """Rows of (value[, crawl]) with one JSON object each to captures.

    Blank lines are skipped.  Missing text is "", missing numbers are 0.  FAILFAST raises for bad
    JSON or a missing or bad timestamp; PERMISSIVE gives such lines a null timestamp and adds
    ``_corrupt`` with the line.
    """
    source = lines.where(F.trim("value") != "")
    tag = F.lit(crawl) if crawl is not None else F.col("crawl")
    j = F.from_json("value", _LINE, {"mode": "PERMISSIVE"})
    row = source.select(tag.alias("crawl"), "value", j.alias("j"))
    text = lambda c: F.coalesce(F.col(f"j.{c}"), F.lit(""))
    number = lambda c: F.greatest(F.coalesce(F.col(f"j.{c}").try_cast("long"), F.lit(0)), F.lit(0).cast("long"))
    stamp = parse_stamp(F.col("j.timestamp"))
    if mode == "FAILFAST":
        stamp = F.when(stamp.isNull(), F.raise_error(F.concat(F.lit("bad index line: "), F.col("value"))).cast("timestamp")).otherwise(stamp)
    out = row.select(
        "crawl", text("urlkey").alias("urlkey"), text("url").alias("url"), stamp.alias("timestamp"), F.coalesce(F.col("j.status").try_cast("int"), F.lit(0)).alias("status"),
        F.col("j.mime").alias("mime"), F.col("j.mime-detected").alias("mime_detected"), languages(F.col("j.languages")).alias("languages"), text("digest").alias("digest"),
        number("length").alias("length"), number("offset").alias("offset"), text("filename").alias("filename"), F.col("j.redirect").alias("redirect"), F.col("j.truncated").alias("truncated"), "value",
    )
    return out.drop("value") if mode == "FAILFAST" else out.withColumn("_corrupt", F.when(F.col("timestamp").isNull(), F.col("value"))).drop("value")


def read_lines(spark: SparkSession, paths: dict[str, str | list[str]], mode: str = "FAILFAST") -> DataFrame:
    """Pages of index lines by crawl: {crawl: path or paths}, one file a page."""
    parts = [parse_lines(spark.read.text(p), crawl, mode) for crawl, p in paths.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def page_count(spark: SparkSession, path: str) -> int:
    return len(spark.read.text(path).inputFiles())


def from_index(table: DataFrame) -> DataFrame:
    """Rows of the columnar index to captures; ``crawl`` stays the partition column.

    Key, time and status are the file's own columns, nulls included, so that filters on them reach
    the files; ``with_defaults`` fills the nulls behind the filters.  Absent columns are null or,
    as all others' nulls, take their defaults.
    """
    types = dict(table.dtypes)

    def column(c: str) -> Column:
        kind = INDEX_COLUMNS[c]
        if c not in types:
            return F.lit(None).cast(kind)
        return F.col(c) if types[c] == kind or (kind == "timestamp" and types[c] == "timestamp_ntz") else F.col(c).cast(kind)

    col = {c: column(c) for c in INDEX_COLUMNS}
    text = lambda c: F.coalesce(col[c], F.lit(""))
    return table.select(
        "crawl", col["url_surtkey"].alias("urlkey"), text("url").alias("url"), col["fetch_time"].alias("timestamp"), col["fetch_status"].alias("status"),
        col["content_mime_type"].alias("mime"), col["content_mime_detected"].alias("mime_detected"), languages(col["content_languages"]).alias("languages"), text("content_digest").alias("digest"),
        F.greatest(F.coalesce(col["warc_record_length"], F.lit(0)), F.lit(0).cast("long")).alias("length"), F.greatest(F.coalesce(col["warc_record_offset"], F.lit(0)), F.lit(0).cast("long")).alias("offset"),
        text("warc_filename").alias("filename"), F.lit(None).cast("string").alias("redirect"), F.lit(None).cast("string").alias("truncated"),
    )


def with_defaults(captures: DataFrame) -> DataFrame:
    """Null keys become "", null statuses 0, null times the epoch; columns that can't be null are left alone."""
    fill = {"urlkey": F.lit(""), "status": F.lit(0), "timestamp": F.timestamp_seconds(F.lit(0)).cast(dict(captures.dtypes).get("timestamp", "timestamp"))}
    null = {f.name for f in captures.schema if f.nullable}
    return captures.withColumns({c: F.coalesce(c, v) for c, v in fill.items() if c in null})


def read_index(spark: SparkSession, root: str, subset: str = "warc") -> DataFrame:
    """The partitioned index below ``root``; filters on crawl prune partitions, those on keys, times, statuses and types reach the files."""
    table = spark.read.parquet(f"{root.rstrip('/')}/{INDEX_PATH}")
    return from_index(table.where(F.col("subset") == subset))


def to_index(captures: DataFrame, subset: str = "warc") -> DataFrame:
    """Captures as rows of the columnar index, with the host columns of that index."""
    source = {"url_surtkey": "urlkey", "url": "url", "fetch_time": "timestamp", "fetch_status": "status", "content_mime_type": "mime", "content_mime_detected": "mime_detected", "content_digest": "digest", "warc_filename": "filename", "warc_record_offset": "offset", "warc_record_length": "length"}
    return captures.select(
        *(F.col(v).alias(k) for k, v in source.items()), F.array_join("languages", ",").alias("content_languages"), host_name(F.col("url")).alias("url_host_name"), tld(F.col("urlkey")).alias("url_host_tld"),
        "crawl", F.lit(subset).alias("subset"),
    )


def write_index(captures: DataFrame, root: str, subset: str = "warc") -> None:
    """The index's layout below ``root``: files by crawl and subset, each sorted by key, so that key ranges skip files and row groups."""
    # the ranges are drawn by a run of the plan: host columns are added behind them
    rows = captures.repartitionByRange("crawl", "urlkey").sortWithinPartitions("crawl", "urlkey", "timestamp")
    to_index(rows, subset).write.mode("append").partitionBy("crawl", "subset").parquet(f"{root.rstrip('/')}/{INDEX_PATH}")


def partition_path(crawl: str, subset: str = "warc") -> str:
    return f"{INDEX_PATH}/crawl={crawl}/subset={subset}"


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """The crawl list, newest first as the file has it: ``crawl_ord`` 0 is the newest."""
    rows = spark.read.schema("id string, name string, `cdx-api` string, `from` string, `to` string").json(path, multiLine=True)
    # one small file is read by one task, in order
    return rows.coalesce(1).withColumn("crawl_ord", F.monotonically_increasing_id().cast("int"))


def registry(spark: SparkSession, rows: list[tuple[str, str | None, str | None]]) -> DataFrame:
    """A registry from (id, from, to), newest first."""
    data = [(i, i, "", a, b, k) for k, (i, a, b) in enumerate(rows)]
    return spark.createDataFrame(data, "id string, name string, `cdx-api` string, `from` string, `to` string, crawl_ord int")


def with_crawl_order(captures: DataFrame, crawls: DataFrame) -> DataFrame:
    """Adds ``crawl_ord``; rows of unknown crawls go.  The registry has about one row a month; a large one is joined without a hint."""
    order = crawls.select(F.col("id").alias("crawl"), "crawl_ord")
    return captures.join(F.broadcast(order) if order.limit(BROADCAST_CRAWLS + 1).count() <= BROADCAST_CRAWLS else order, "crawl")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Captures that a JSON-lines manifest holds; one bad line fails the read."""
    return spark.read.schema(CAPTURE).json(path, mode="FAILFAST", timestampFormat="yyyy-MM-dd'T'HH:mm:ss[.SSS]XXX").select(*COLUMNS)


def parse_manifest(lines: DataFrame) -> DataFrame:
    """The same from rows of (value), as read from standard input."""
    j = F.from_json(F.trim("value"), CAPTURE, {"mode": "FAILFAST", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSS]XXX"})
    return lines.where(F.trim("value") != "").select(j.alias("j")).select("j.*").withColumn("languages", F.coalesce("languages", F.array().cast("array<string>")))
