"""What tasks and the driver hold doesn't grow with the tables."""

from __future__ import annotations

import gzip
import random
from datetime import datetime, timedelta

import pyarrow as pa
from pyspark.sql import functions as F

from webstrata import derived, stored_queries
from webstrata.api import Archive, Settings
from webstrata.operators import payload
from webstrata.sources import ranges
from webstrata.stored_queries import _page_captures, archived
from webstrata.streaming import captures as streams


def test_payloads_are_never_broadcast(spark, sf_dir):
    root, locators = archived(spark, sf_dir)
    captures = _page_captures(spark, sf_dir, locators)
    got = Archive(spark, captures, derived.crawls(spark), settings=Settings(archives=root)).fetch(captures)
    rows = got.collect()
    assert len(rows) == captures.count() and sum(r["error"] is not None for r in rows) == 1
    text = got._jdf.queryExecution().executedPlan().toString()
    final = text.split("Initial Plan")[0]
    # the first join is that with the payloads
    assert final[final.index("Join") - 9 :].startswith("SortMergeJoin [digest")


def run_stream(spark, tmp_path, parts, step):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for part in parts:
        part.write.mode("append").parquet(source)
        step(spark.readStream.schema(part.schema).parquet(source)).writeStream.trigger(availableNow=True).option("checkpointLocation", state).start(out, format="parquet").awaitTermination()
    return spark.read.parquet(out)


def test_a_closed_stream_gives_every_change(spark, tmp_path):
    rows = [(f"k{k}", datetime(2024, 1, 1) + timedelta(hours=h), "f", 100 * k + h, f"d{h // 2 % 2}") for k in range(50) for h in range(10)]
    given = spark.createDataFrame(rows, "urlkey string, timestamp timestamp, filename string, offset long, digest string")
    late = F.col("offset") % 3 == 1
    streams.keep_state_on_disk(spark)
    try:
        # a bucket holds many keys
        got = run_stream(spark, tmp_path, [given.where(~late), given.where(late), streams.closing(given, "1 day")], lambda s: streams.stream_changes(s, "1 day", 4))
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert sorted((r["urlkey"], r["offset"]) for r in got.collect()) == sorted((f"k{k}", 100 * k + h) for k in range(50) for h in range(0, 10, 2))


class Frame:
    """Stands for a DataFrame, to run what a task runs."""

    columns, dtypes = ["id", "raw"], [("id", "bigint"), ("raw", "binary")]

    def select(self, *names):
        return self

    def mapInArrow(self, run, schema):
        return run


def test_a_task_decodes_a_bounded_part_of_a_batch():
    body = random.Random(1).randbytes(1 << 19)
    block = b"HTTP/1.1 200 OK\r\n\r\n" + body
    raw = gzip.compress(b"WARC/1.0\r\nContent-Length: %d\r\n\r\n" % len(block) + block, 1)
    batch = pa.RecordBatch.from_arrays([pa.array(range(60)), pa.array([raw] * 59 + [None], pa.binary())], names=["id", "raw"])
    made = list(payload.decode_payloads(Frame(), strict=True, parts=("record", "body"))(iter([batch])))
    assert max(len(b) for b in made) <= payload.OUT_BYTES >> 19 and max(b.nbytes for b in made) < 3 * payload.OUT_BYTES
    assert [i for b in made for i in b.column(0).to_pylist()] == list(range(60))
    assert all(x == body for b in made for x in b.column("body").to_pylist()[: 59 - b.column(0)[0].as_py()])
    assert made[-1].column("body").to_pylist()[-1] is None


def test_index_captures_are_derived_once(spark, sf_dir, monkeypatch):
    given = []
    monkeypatch.setattr(stored_queries, "_indexes", {})
    monkeypatch.setattr(stored_queries.src, "write_index", lambda rows, root, subset="warc": given.append(rows._jdf.queryExecution().optimizedPlan().toString()))
    stored_queries.index_root(spark, sf_dir)
    assert len(given) == 2 and not any("Join" in plan for plan in given)


def test_addresses_are_keyed_once_a_page(spark, sf_dir):
    plan = derived.captures(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    # what is computed above the join knows no host
    assert "regexp_extract" not in plan[: plan.index("Join")] and "regexp_extract" in plan


def test_no_more_read_tasks_than_slabs(spark):
    """A share of one byte doesn't ask for a task a byte."""
    given = spark.createDataFrame([(f"d{k}", "f", 1000 * k, 900) for k in range(20)], "digest string, filename string, offset long, length long")
    planned = ranges.reads(given, 0, 2000)
    dealt, tasks = ranges.packed(planned, 1, filled=True)
    assert tasks == 10 == dealt.select("r_task").distinct().count() and dealt.count() == 20
    assert ranges.packed(planned, 1)[1] == 18_000
    assert ranges.packed(planned, 5_000, filled=True)[1] == 4
