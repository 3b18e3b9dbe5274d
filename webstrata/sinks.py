"""Output forms: JSON lines, CSV, aligned text, payload tables and files."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .functions.fields import safe_name, stamp
from .schema import COLUMNS
from .session import stored

CSV_COLUMNS = ("crawl", "timestamp", "status", "url", "digest", "filename", "offset", "length")


def ndjson(captures: DataFrame) -> DataFrame:
    """One JSON object a row, in the contract's column order, nulls written, times in RFC 3339."""
    ready = captures.select(*(F.col(c).cast("timestamp").alias(c) if c == "timestamp" else F.col(c) for c in COLUMNS))
    return ready.select(F.to_json(F.struct(*COLUMNS), {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ssXXX"}).alias("value"))


def csv_field(c: Column) -> Column:
    """Quoted only where a comma or quote needs it."""
    return F.when(c.rlike('[,"]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def csv_rows(captures: DataFrame) -> DataFrame:
    """CSV lines without the header, which is ``CSV_COLUMNS``."""
    cells = [stamp(F.col(c)) if c == "timestamp" else csv_field(F.col(c)) if c in ("url", "filename") else F.col(c).cast("string") for c in CSV_COLUMNS]
    return captures.select(F.concat_ws(",", *cells).alias("value"))


def table_rows(captures: DataFrame) -> DataFrame:
    return captures.select(F.format_string("%-16s %-14s %3d  %s", "crawl", stamp(F.col("timestamp")), "status", "url").alias("value"))


def template_rows(bound: DataFrame) -> DataFrame:
    """(url, vars) as JSON lines."""
    return bound.select(F.to_json(F.struct("url", "vars")).alias("value"))


def crawl_rows(registry: DataFrame) -> DataFrame:
    return registry.orderBy("crawl_ord").select(F.concat_ws("\t", "id", F.coalesce("name", F.lit(""))).alias("value"))


def payload_table(payloads: DataFrame) -> DataFrame:
    """(name, body): file-safe names from digests."""
    return payloads.select(safe_name(F.col("digest")).alias("name"), "body")


@dataclass
class _Files(WriterCommitMessage):
    """What a task wrote, for its commit: the folder of its attempt."""

    attempt: str


class PayloadFiles(DataSource):
    """``payload_files``: writes (name, body) as files of their own, all or none of a task's, and none of a job that fails.

    A task writes into a folder of its attempt below ``_attempt-<job>``, which the driver makes; the
    job's commit moves the files of the attempts that count into place.  A failed job's folder is
    dropped, and tasks that are still at work can't write without it.
    """

    @classmethod
    def name(cls) -> str:
        return "payload_files"

    def schema(self) -> str:
        return "name string, body binary"

    def writer(self, schema: Any, overwrite: bool) -> DataSourceArrowWriter:
        made = _FileWriter(self.options["path"], int(self.options.get("movers", 16)))
        store, base = made._store()
        store.create_dir(f"{base}/{made.job}", recursive=True)
        return made


class _FileWriter(DataSourceArrowWriter):
    def __init__(self, root: str, movers: int) -> None:
        self.root, self.job, self.movers = root, f"_attempt-{uuid.uuid4().hex}", movers

    def _store(self) -> tuple[fs.FileSystem, str]:
        store, base = fs.FileSystem.from_uri(self.root) if "://" in self.root else (fs.LocalFileSystem(), self.root)
        return store, base.rstrip("/")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, base = self._store()
        attempt = f"{base}/{self.job}/{uuid.uuid4().hex}"
        store.create_dir(attempt, recursive=False)
        for batch in iterator:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if name and body.is_valid:
                    with store.open_output_stream(f"{attempt}/{name}", compression=None) as f:
                        f.write(body.as_buffer())
        return _Files(attempt)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        """Move the files of each counted attempt; names of one attempt are held at a time."""
        store, base = self._store()
        with ThreadPoolExecutor(self.movers) as pool:
            for m in messages:
                if m is not None:
                    names = [x.base_name for x in store.get_file_info(fs.FileSelector(m.attempt, allow_not_found=True))]  # type: ignore[attr-defined]
                    list(pool.map(lambda n, at=m.attempt: store.move(f"{at}/{n}", f"{base}/{n}"), names))  # type: ignore[attr-defined]
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, base = self._store()
        for last in (False, False, True):
            try:
                if store.get_file_info(f"{base}/{self.job}").type != fs.FileType.NotFound:
                    store.delete_dir(f"{base}/{self.job}")
                return
            except OSError:  # a task wrote meanwhile
                if last:
                    raise


def write_payload_files(payloads: DataFrame, root: str) -> DataFrame:
    """Write every (name, body) as a file of its own below ``root`` (a path or URI that pyarrow opens) and give (name, bytes, error).

    An action: payloads are stored first, so that what is said and what is written are the same.  A
    null body writes nothing and says so; of rows that share a name one stays.  Files appear when
    the whole job has succeeded; a task that fails or is tried again leaves nothing.
    """
    spark = payloads.sparkSession
    spark.dataSource.register(PayloadFiles)
    rows = stored(payloads.select("name", "body"), "payload-files")
    rows.where("name <> '' and body is not null").write.format("payload_files").mode("append").save(root)
    error = F.when(F.coalesce(F.col("name"), F.lit("")) == "", "no name").when(F.col("body").isNull(), "no payload")
    return rows.select("name", F.when(error.isNull(), F.length("body").cast("long")).alias("bytes"), error.alias("error"))


def write_captures(captures: DataFrame, path: str) -> None:
    """A columnar table by crawl, sorted by key inside, so that key ranges skip row groups."""
    captures.repartitionByRange("crawl", "urlkey").sortWithinPartitions("crawl", "urlkey", "timestamp").write.partitionBy("crawl").parquet(path)
