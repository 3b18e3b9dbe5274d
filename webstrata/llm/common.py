"""Shared helpers of the training-data operators: table access, shared storage, Arrow batches."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sinks import PayloadFiles


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that setting is absent and the master is local (tests) a temporary folder is made and registered.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            base = current.get()
        elif not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        else:
            base = "file://" + tempfile.mkdtemp(prefix="webstrata-")
            spark.sparkContext.setCheckpointDir(base)
    elif not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/webstrata/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it again: cuts lineage, survives lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a table that is joined by broadcast.
FEW = 20_000


def few(df: DataFrame, most: int = FEW) -> DataFrame:
    """A stored table, marked for broadcast if it has ``most`` rows or fewer; a larger one is joined by its key."""
    return F.broadcast(df) if df.count() <= most else df


def export_files(rows: DataFrame, root: str) -> None:
    """Write every (name, blob) as a file of its own below ``root`` (a path or URI that pyarrow opens).

    An action.  Names must be unique; a null name or blob writes nothing.  Files appear when the
    whole job has succeeded; a task that fails or is tried again leaves nothing.
    """
    rows.sparkSession.dataSource.register(PayloadFiles)
    rows.select("name", F.col("blob").alias("body")).write.format("payload_files").mode("append").save(root)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Batch-at-a-time ``mapInArrow``; ``fn`` may give None for no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                if out is not None:
                    yield out

    return df.mapInArrow(run, schema)


def text_column() -> Column:
    """The ``text`` column, null taken as empty."""
    return F.coalesce(F.col("text"), F.lit(""))


def by_bytes(texts: list[str], limit: int) -> Iterator[tuple[int, int]]:
    """Index ranges of ``texts`` that hold about ``limit`` characters each, one text at least."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


#: Unicode White_Space plus the separators U+001C..1F that Python alone counts as space.
PYTHON_ONLY_SPACE = re.compile("[\x1c-\x1f]")
