"""Streaming forms of the stateful operators."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.budget import Budget, spend
from ..sources.captures import parse_lines


def stream_lines(spark: SparkSession, path: str, crawl: str, files_per_trigger: int = 100) -> DataFrame:
    """Captures from index pages as they arrive in a folder."""
    return parse_lines(spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path), crawl, mode="PERMISSIVE").drop("_corrupt")


def stream_distinct(captures: DataFrame, watermark: str | None = None) -> DataFrame:
    """The first arrival of each URL key; with a watermark, keys are forgotten once it passes them."""
    if watermark:
        return captures.withWatermark("timestamp", watermark).dropDuplicatesWithinWatermark(["urlkey"])
    return captures.dropDuplicates(["urlkey"])


#: Buckets of keys that ``stream_changes`` keeps its state by.
BUCKETS = 4096
_ROWS = pa.schema([("urlkey", pa.string()), ("at", pa.int64()), ("filename", pa.string()), ("offset", pa.int64()), ("digest", pa.string())])


def _packed(table: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as writer:
        writer.write_table(table)
    return out.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


class _Changes(StatefulProcessor):
    """Rows of a bucket of keys wait in time until the watermark has passed them; then each is compared with the one before of its key.

    A call of the state store costs far more than a row, so that a bucket's rows go to it and come from it together.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.last = handle.getValueState("last", "digests binary")

    def wake(self, at: list[int]) -> None:
        """One timer a bucket: at its earliest waiting row."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if at:
            self.handle.registerTimer(max(1, min(at)))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = pa.concat_tables([pa.Table.from_pandas(part[_ROWS.names], _ROWS, preserve_index=False) for part in rows])
        new = new.filter(pc.is_valid(new["urlkey"]))
        if new.num_rows:
            self.waiting.appendValue((_packed(new),))
            self.wake([*self.handle.listTimers(), pc.min(new["at"]).as_py() // 1000])
        return iter([])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        passed = (timerValues.getCurrentWatermarkInMs() + 1) * 1000
        rows = pa.concat_tables([_unpacked(r[0]) for r in self.waiting.get()])
        early = pc.less(rows["at"], passed)
        due, rest = rows.filter(early), rows.filter(pc.invert(early))
        due = due.sort_by([(c, "ascending") for c in ("urlkey", "at", "filename", "offset")])
        held = self.last.get()
        last = dict(zip(*(c.to_pylist() for c in _unpacked(held[0]).columns), strict=True)) if held else {}
        changed = []
        for url, digest in zip(due["urlkey"].to_pylist(), due["digest"].to_pylist(), strict=True):
            changed.append(url not in last or last[url] != digest)
            last[url] = digest
        if changed:
            self.last.update((_packed(pa.table({"urlkey": pa.array(last.keys(), pa.string()), "digest": pa.array(last.values(), pa.string())})),))
        if rest.num_rows:
            self.waiting.put([(_packed(rest),)])
            self.wake([pc.min(rest["at"]).as_py() // 1000])
        else:
            self.waiting.clear()
            self.wake([])
        if any(changed):
            yield due.filter(pa.array(changed)).select(["urlkey", "at", "digest", "offset"]).to_pandas()

    def close(self) -> None:
        pass


def stream_changes(captures: DataFrame, late: str = "1 day", buckets: int = BUCKETS) -> DataFrame:
    """(urlkey, timestamp, digest, offset) of rows whose digest differs from the one before of their key in time; the first row of a key counts.

    Rows may arrive in any order as long as they are at most ``late`` behind the latest: they wait in
    state until the watermark passes them and are compared in the order of time, filename and
    offset, so the answer is the batch form's.  Rows behind the watermark are dropped and counted
    (``dropped_rows``).  Rows without a key only move the watermark: ``closing`` makes one that ends
    a stream.  State is the rows of that delay and one digest a key, by ``buckets`` of keys: a task
    holds one bucket at a time, so let their number grow with what waits; it is fixed for a checkpoint.
    """
    at = F.col("timestamp").cast("timestamp")
    chosen = captures.select("urlkey", at.alias("timestamp"), F.unix_micros(at).alias("at"), "filename", "offset", "digest").withWatermark("timestamp", late)
    dealt = chosen.withColumn("bucket", F.pmod(F.xxhash64("urlkey"), F.lit(buckets)).cast("int")).groupBy("bucket")
    found = dealt.transformWithStateInPandas(_Changes(), "urlkey string, at long, digest string, offset long", "append", "EventTime")
    return found.select("urlkey", F.timestamp_micros("at").alias("timestamp"), "digest", "offset")


def closing(captures: DataFrame, late: str = "1 day") -> DataFrame:
    """One row of the same columns, without a key and so far ahead of ``captures`` that the watermark passes all of them: as a stream's last row it has nothing wait any more."""
    end = captures.agg(F.max("timestamp").alias("timestamp"))
    return end.select(*(F.expr(f"timestamp + interval {late} + interval 1 second").cast(kind).alias(c) if c == "timestamp" else F.lit(None).cast(kind).alias(c) for c, kind in captures.dtypes))


#: The state store that timers and list state need.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_state_on_disk(spark: SparkSession) -> None:
    """Have streams that start from now on keep their state in RocksDB, which ``stream_changes`` needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def sessions(captures: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(urlkey, start, stop, n, bytes) of visits to a key that lie less than ``gap`` apart; a late row may join two sessions until the watermark passes them."""
    timed = captures.withColumn("timestamp", F.col("timestamp").cast("timestamp")).withWatermark("timestamp", late)
    found = timed.groupBy("urlkey", F.session_window("timestamp", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("bytes"))
    return found.select("urlkey", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n", "bytes")


def dropped_rows(query: StreamingQuery) -> int:
    """Rows that a stream's operators dropped because they were behind the watermark, as far as its progress is kept."""
    return sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)


def write_within(captures: DataFrame, limits: Budget, path: str, checkpoint: str) -> StreamingQuery:
    """Start a stream that appends captures to ``path`` until a budget of records or bytes is spent; each trigger takes the first in order.

    The first row that doesn't fit ends it, smaller ones behind it included, as in the batch form.
    Inside a trigger the cut is found by sums of ranges.  What is spent stands in a ledger below
    ``path``, a line a trigger, written after the trigger's rows; a trigger reads the lines of those
    before it alone and overwrites its own rows and line, so a restart neither loses nor repeats rows.
    """
    ledger = f"{path.rstrip('/')}/_ledger"

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ledger)
        there = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(base)
        lines = spark.read.schema("records long, bytes long, closed boolean, trigger int").option("basePath", ledger).parquet(ledger).where(F.col("trigger") < number) if there else None
        r = lines.agg(F.coalesce(F.sum("records"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.bool_or("closed"), F.lit(False))).first() if lines is not None else (0, 0, False)
        if r[2]:
            kept, over = batch.limit(0), True
        else:
            left = Budget(None if limits.records is None else limits.records - r[0], None if limits.bytes is None else limits.bytes - r[1])
            kept, over = spend(batch, left)
        kept.write.mode("overwrite").parquet(f"{path.rstrip('/')}/trigger={number}")
        done = spark.read.schema(kept.schema).parquet(f"{path.rstrip('/')}/trigger={number}").agg(F.count(F.lit(1)).alias("records"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
        done.withColumn("closed", F.lit(bool(over))).write.mode("overwrite").parquet(f"{ledger}/trigger={number}")

    return captures.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_within_records(captures: DataFrame, most: int, path: str, checkpoint: str) -> StreamingQuery:
    """``write_within`` for records alone."""
    return write_within(captures, Budget(records=most), path, checkpoint)


def windowed_counts(captures: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Captures per event-time window and status, late rows up to the watermark."""
    return captures.withColumn("timestamp", F.col("timestamp").cast("timestamp")).withWatermark("timestamp", late).groupBy(F.window("timestamp", size, slide), "status").count()
