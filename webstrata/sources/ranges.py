"""Payload ranges: read ``length`` bytes at ``offset`` of archive files.

Neighbouring ranges of a file become one read up to a gap, and reads are packed into tasks by
bytes, in the order of files and offsets: a large archive is spread over tasks, small ones share
one, and no task has many more bytes than another.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ArchiveError
from ..operators.ordered import in_ranges, with_total_before
from ..session import stored
from ..transport import Transport

#: Bytes between two ranges that are read along, bytes of a slab (reads end with the last range that starts in it), and bytes of a task.
GAP, SLAB, TASK_BYTES = 64 << 10, 64 << 20, 256 << 20
#: Bytes of ranges that a task passes on at once.
OUT_BYTES = 4 << 20


def reads(locators: DataFrame, gap: int = GAP, slab: int = SLAB) -> DataFrame:
    """Locators with the read that holds each: r_slab, r_start, r_stop, and r_first at one range of each read.

    Ranges that overlap, touch or lie up to ``gap`` bytes apart share a read, if they start in the
    same slab of their file; so what is sorted together is a slab, however large the file.
    """
    key = ("filename", "r_slab")
    order = Window.partitionBy(*key).orderBy("offset", "length", "digest")
    stop = F.col("offset") + F.col("length")
    behind = F.max(stop).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = locators.withColumn("r_slab", F.floor(F.col("offset") / slab).cast("long")).withColumn("r_first", behind.isNull() | (F.col("offset") > behind + gap))
    rows = rows.withColumn("r_read", F.sum(F.col("r_first").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    one = Window.partitionBy(*key, "r_read")
    return rows.withColumns({"r_start": F.min("offset").over(one), "r_stop": F.max(stop).over(one)}).drop("r_read")


def packed(planned: DataFrame, task_bytes: int | None = None, tasks: int | None = None, filled: bool = False) -> tuple[DataFrame, int]:
    """(planned reads with r_task, number of tasks): slabs in order, a task ends where it has its bytes.

    ``task_bytes``, or an even share of all bytes for ``tasks``; without both, ``TASK_BYTES`` or less, so
    that every core has a share.  A slab is never split, so a task has fewer bytes than its share and
    one slab's.
    """
    size = F.sum(F.when(F.col("r_first"), F.col("r_stop") - F.col("r_start")).otherwise(0))
    slabs = in_ranges(planned.groupBy("filename", "r_slab").agg(size.alias("r_bytes")), [F.col("filename"), F.col("r_slab")], "read-slabs")
    slabs, total = with_total_before(slabs, "r_bytes")
    if task_bytes is None:
        share = -(-total // (tasks or planned.sparkSession.sparkContext.defaultParallelism))
        task_bytes = max(1, share if tasks else min(TASK_BYTES, share))
    elif filled:
        task_bytes = max(task_bytes, -(-total // max(1, slabs.count())))
    dealt = slabs.select(F.col("filename").alias("s_file"), F.col("r_slab").alias("s_slab"), F.floor(F.col("o_before") / task_bytes).cast("int").alias("r_task"))
    made = planned.join(dealt, (F.col("filename") == F.col("s_file")) & (F.col("r_slab") == F.col("s_slab"))).drop("s_file", "s_slab")
    return made, max(0, total - 1) // task_bytes + 1


def _file_reader(root: str) -> Callable[[str, int, int], bytes]:
    store, base = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
    now: list = [None, None]

    def read(filename: str, offset: int, length: int) -> bytes:
        if filename != now[0]:
            now[:] = [filename, None]
            now[1] = store.open_input_file(f"{base.rstrip('/')}/{filename}")
        if now[1] is None:
            raise FileNotFoundError(filename)
        size = now[1].size()
        return now[1].read_at(max(0, min(length, size - offset)), min(offset, size))

    return read


def read_ranges(root: str, locators: DataFrame, transport: Transport | None = None, workers: int | None = None, gap: int = GAP, slab: int = SLAB, task_bytes: int | None = None) -> DataFrame:
    """locators(digest, filename, offset, length) to (digest, raw, error): one row each.

    A range that ends past the file, a missing file and a failed request give a null ``raw`` and say
    why in ``error``; an empty range is empty bytes and reads nothing.  Null locators are errors
    too.  A read that fails is tried again range by range, so that each has its own error.

    root: a path or URI of a store that pyarrow opens (file, hdfs, s3, gs); with a transport, the
    address before file names, and a read is one request.  workers: tasks that send requests at
    most, so that they share its rate evenly; bytes are dealt evenly among them.

    Sizes of the reads are planned when this is called; bytes are read when the result is.
    """
    names = ("digest", "filename", "offset", "length")
    given = stored(locators.select("digest", "filename", *(F.col(c).cast("long").alias(c) for c in ("offset", "length"))), "locators")
    sound = F.coalesce((F.col("offset") >= 0) & (F.col("length") >= 0) & F.col("filename").isNotNull(), F.lit(False))
    dealt, tasks = packed(reads(given.where(sound), gap, slab), task_bytes, workers, filled=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if transport is not None:
            polite = transport.shared_by(workers) if workers and hasattr(transport, "shared_by") else transport
            read = lambda name, offset, length: polite.get_range(f"{root.rstrip('/')}/{name}", offset, length)
        else:
            read = _file_reader(root)
        now, data = None, None  # the read at hand; no bytes if it failed
        digests, raws, errors, size = [], [], [], 0

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(digests, kind), pa.array(raws, pa.binary()), pa.array(errors, pa.string())], names=["digest", "raw", "error"])

        for batch in batches:
            kind = batch.schema.field(0).type
            for digest, filename, offset, length, start, stop in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw, error = None, None
                try:
                    if (filename, start) != now and length:
                        now, data = (filename, start), None
                        try:
                            data = read(filename, start, stop - start)
                        except (OSError, ValueError, ArchiveError):
                            if (offset, offset + length) == (start, stop):
                                raise
                    if not length:
                        raw = b""
                    else:
                        raw = read(filename, offset, length) if data is None else data[offset - start : offset - start + length]
                    if len(raw) != length:
                        raw, error = None, f"{len(raw)} of {length} bytes at {offset} of {filename}"
                except (OSError, ValueError, ArchiveError) as e:
                    error = f"{type(e).__name__}: {e}"
                digests.append(digest)
                raws.append(raw)
                errors.append(error)
                size += length if raw else 0
                if size >= OUT_BYTES:
                    yield made()
                    digests, raws, errors, size = [], [], [], 0
        if digests:
            yield made()

    got = dealt.repartitionById(tasks, F.col("r_task")).sortWithinPartitions("filename", "r_start", "offset").select(*names, "r_start", "r_stop")
    kind = dict(given.dtypes)["digest"]
    lost = given.where(~sound).select("digest", F.lit(None).cast("binary").alias("raw"), F.lit("ValueError: no locator").alias("error"))
    return got.mapInArrow(run, f"digest {kind}, raw binary, error string").unionByName(lost)
