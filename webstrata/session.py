"""Session defaults and shared storage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import ConfigError


def session(app: str = "webstrata", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC times and adaptive execution; partitions are left to the cluster's settings."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder of ``spark.checkpoint.dir``, which driver and executors share; only a local master may leave it unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ConfigError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="webstrata-")
    return f"{base.rstrip('/')}/webstrata/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written as Parquet to the shared folder and read again: run once, lineage cut."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a table that is joined by broadcast.
FEW = 20_000


def few(df: DataFrame, most: int = FEW) -> DataFrame:
    """A stored table, marked for broadcast if it has ``most`` rows or fewer; a larger one is joined by its keys."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
