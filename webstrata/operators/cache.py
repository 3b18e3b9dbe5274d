"""Payload and index cache as a table: (domain, key, value, written, ttl), ttl 0 never expires.

Tiers are tables: ``CacheStore`` is one on storage, in folders by domain and hash of the key,
``MemoryTier`` one in memory, ``empty`` none at all; ``layered`` reads through two.
"""

from __future__ import annotations

import uuid
from typing import Any, NamedTuple

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import few, stored
from .ordered import in_ranges, with_total_before

SCHEMA = "domain string, key string, value binary, written long, ttl long"
DOMAINS = ("registry", "index", "payload")
_NAMES = ("domain", "key", "value", "written", "ttl")
#: Columns of a stored entry, the folders' last.
STORED = "key string, value binary, written long, ttl long, size long, write string, domain string, bucket int"
#: What tells entries of a key apart without their values.
PLACE = ("written", "ttl", "size", "at_file", "at_row")
#: Folders that the keys of a domain are spread over.
BUCKETS = 256
_LATEST = ("written", "at_file", "at_row")


def bucket_of(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def newest_of(entries: DataFrame) -> DataFrame:
    """The latest of each (domain, key), without values: tasks pass on one a key."""
    best = entries.groupBy("domain", "key").agg(F.max(F.struct("written", "at_file", "at_row", "ttl", "size")).alias("v"))
    return best.select("domain", "key", "v.*")


def superseded(entries: DataFrame) -> DataFrame:
    """Places of entries that a later one of their key replaced."""
    light = entries.select("domain", "key", *PLACE)
    rank = F.row_number().over(Window.partitionBy("domain", "key").orderBy(*map(F.desc, _LATEST)))
    return light.withColumn("nth", rank).where("nth > 1")


def expired(now: Column) -> Column:
    return (F.col("ttl") > 0) & (now > F.col("written") + F.col("ttl"))


def get(cache: DataFrame, domain: str, keys: DataFrame, now: Column) -> DataFrame:
    """Live entries of the wanted keys (a ``key`` column)."""
    return cache.where((F.col("domain") == domain) & ~expired(now)).join(keys.select("key"), "key", "left_semi")


def put(cache: DataFrame, entries: DataFrame) -> DataFrame:
    """The cache with entries added; of one key the latest written stays."""
    both = cache.unionByName(entries)
    cols = [c for c in both.columns if c not in ("domain", "key")]
    best = both.groupBy("domain", "key").agg(F.max(F.struct("written", *(c for c in cols if c != "written"))).alias("v"))
    return best.select("domain", "key", *(F.col(f"v.{c}").alias(c) for c in cols)).select(*cache.columns)


def stats(cache: DataFrame) -> DataFrame:
    return cache.groupBy("domain").agg(F.count(F.lit(1)).alias("entries"), F.sum(F.length("value")).alias("bytes"))


def collect_garbage(cache: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(live entries, one row of reclaimed bytes)."""
    return cache.where(~expired(now)), cache.where(expired(now)).agg(F.coalesce(F.sum(F.length("value")), F.lit(0)).alias("reclaimed"))


def layered(fast: DataFrame, slow: DataFrame) -> DataFrame:
    """Read-through: entries of the fast tier, and of the slow tier those that it lacks, without their ttl."""
    return fast.unionByName(slow.join(fast.select("domain", "key"), ["domain", "key"], "left_anti").withColumn("ttl", F.lit(0).cast("long")))


def empty(spark: SparkSession) -> DataFrame:
    """The tier that holds nothing."""
    return spark.createDataFrame([], SCHEMA)


class CacheStore(NamedTuple):
    """A tier on storage: ``write=<id>/domain=<domain>/bucket=<hash of the key>`` below ``path``.

    Entries are only ever added, each write in a folder of its own, so that writers don't meet; the
    latest of a key counts.  An entry without a value is a tombstone: its key is gone.  Keys are
    sorted in their files, which hold a Bloom filter of them and the sizes of values, so that only
    ``get`` and ``table`` read values, and they never shuffle them: what is wanted is found out on
    keys and times alone, and values are picked by file and row.
    """

    spark: SparkSession
    path: str

    def _fs(self) -> tuple[Any, Any]:
        """(Hadoop's file system, its path class)."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return path(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _writes(self) -> list[str]:
        """Finished writes, those that left a mark of success."""
        store, path = self._fs()
        if not store.exists(path(self.path)):
            return []
        return sorted(x.getPath().getParent().toString() for x in store.globStatus(path(f"{self.path.rstrip('/')}/write=*/_SUCCESS")) or [])

    def _rows(self, writes: list[str] | None = None) -> DataFrame:
        """All entries ever added, with their place."""
        writes = self._writes() if writes is None else writes
        if not writes:
            return self.spark.createDataFrame([], STORED).withColumns({"at_file": F.lit(""), "at_row": F.lit(0).cast("long")})
        rows = self.spark.read.schema(STORED).option("basePath", self.path).parquet(*writes)
        return rows.withColumns({"at_file": F.col("_metadata.file_path"), "at_row": F.col("_metadata.row_index")})

    def buckets_of(self, keys: DataFrame) -> list[int]:
        """Buckets of the wanted keys: at most ``BUCKETS`` numbers."""
        return sorted(r[0] for r in keys.select(bucket_of(F.col("key"))).distinct().collect())

    def lookup(self, domain: str, keys: DataFrame, now: Column) -> DataFrame:
        """(key, at_file, at_row, written, ttl, size) of live entries of the wanted keys; no value is read."""
        wanted = keys.select("key").where("key is not null").distinct()
        rows = self._rows().where((F.col("domain") == domain) & F.col("bucket").isin(*(self.buckets_of(wanted) or [-1])))
        latest = newest_of(rows.select("domain", "key", *PLACE).join(wanted, "key", "left_semi"))
        return latest.where(F.col("size").isNotNull() & ~expired(now)).drop("domain")

    def get(self, domain: str, keys: DataFrame, now: Column) -> DataFrame:
        """Live entries of the wanted keys (a ``key`` column); only the buckets of these keys are read."""
        wanted = keys.select("key").where("key is not null").distinct()
        buckets = self.buckets_of(wanted) or [-1]
        found = few(stored(self.lookup(domain, wanted, now).select(F.col("key").alias("f_key"), F.col("at_file").alias("f_file"), F.col("at_row").alias("f_row")), "cache-hits"))
        rows = self._rows().where((F.col("domain") == domain) & F.col("bucket").isin(*buckets))
        return rows.join(found, (F.col("key") == F.col("f_key")) & (F.col("at_file") == F.col("f_file")) & (F.col("at_row") == F.col("f_row")), "left_semi").select(*_NAMES)

    def table(self) -> DataFrame:
        """All entries; of one key the latest, expired ones too."""
        rows = self._rows()
        gone = few(stored(superseded(rows).select(F.col("at_file").alias("g_file"), F.col("at_row").alias("g_row")), "cache-superseded"))
        return rows.where(F.col("size").isNotNull()).join(gone, (F.col("at_file") == F.col("g_file")) & (F.col("at_row") == F.col("g_row")), "left_anti").select(*_NAMES)

    def stats(self) -> DataFrame:
        """(domain, entries, bytes) of the latest entries, from sizes alone."""
        latest = newest_of(self._rows().select("domain", "key", *PLACE)).where(F.col("size").isNotNull())
        return latest.groupBy("domain").agg(F.count(F.lit(1)).alias("entries"), F.sum("size").alias("bytes"))

    def put(self, entries: DataFrame) -> DataFrame:
        """Write entries, and give back those written.  A null value takes the key out."""
        sized = entries.select(*_NAMES).withColumns({"size": F.length("value").cast("long"), "bucket": bucket_of(F.col("key"))})
        path = f"{self.path.rstrip('/')}/write={uuid.uuid4().hex}"
        dealt = sized.hint("rebalance", "domain", "bucket").sortWithinPartitions("domain", "bucket", "key")
        dealt.write.option("parquet.bloom.filter.enabled#key", "true").partitionBy("domain", "bucket").parquet(path)
        return self._rows([path]).select(*_NAMES)

    def remove(self, domain: str, keys: DataFrame, written: Column) -> None:
        """Take keys out, by tombstones of the given time."""
        self.put(keys.select(F.lit(domain).alias("domain"), "key", F.lit(None).cast("binary").alias("value"), written.cast("long").alias("written"), F.lit(0).cast("long").alias("ttl")))

    def collect_garbage(self, now: Column) -> DataFrame:
        """Rewrite the buckets that hold dead entries, and give one row of ``reclaimed`` bytes and ``buckets`` rewritten.

        Dead are expired entries, those that a later one of their key replaced, and tombstones with
        nothing left to hide.  Live entries of touched buckets are written anew before the old
        folders of these buckets are dropped, tombstones last: whoever reads meanwhile sees an
        entry twice, which changes nothing, and a run that is cut short can be repeated.  Other
        buckets aren't read beyond their keys.
        """
        writes = self._writes()
        rows = self._rows(writes)
        # a tombstone with older entries stays until these are gone
        hides = F.col("size").isNull() & (F.count(F.lit(1)).over(Window.partitionBy("domain", "key")) > 1)
        light = rows.select("domain", "bucket", "key", *PLACE)
        latest = F.row_number().over(Window.partitionBy("domain", "key").orderBy(*map(F.desc, _LATEST))) == 1
        judged = stored(light.withColumns({"last": latest, "hides": hides}).withColumn("live", F.col("last") & F.when(F.col("size").isNull(), F.col("hides")).otherwise(~expired(now))), "cache-judged")
        touched = [(r["domain"], r["bucket"]) for r in judged.where("not live").select("domain", "bucket").distinct().orderBy("domain", "bucket").collect()]
        reclaimed = judged.where("not live").agg(F.coalesce(F.sum("size"), F.lit(0).cast("long")).alias("reclaimed")).first()["reclaimed"]
        if touched:
            those = F.lit(False)
            for domain in sorted({d for d, _ in touched}):
                those = those | ((F.col("domain") == domain) & F.col("bucket").isin(*(b for d, b in touched if d == domain)))
            stay = few(stored(judged.where(those).where("live").select(F.col("at_file").alias("l_file"), F.col("at_row").alias("l_row")), "cache-live"))
            self.put(rows.where(those).join(stay, (F.col("at_file") == F.col("l_file")) & (F.col("at_row") == F.col("l_row")), "left_semi"))
            store, path = self._fs()
            tombs = {r[0].rsplit("/", 1)[0] for r in judged.where(those & F.col("size").isNull()).select("at_file").distinct().collect()}
            folders = [f"{w}/domain={d}/bucket={b}" for w in writes for d, b in touched]
            names = {f: "/".join(f.split("/")[-3:]) for f in folders}
            last = {"/".join(t.split("/")[-3:]) for t in tombs}
            for f in sorted(folders, key=lambda f: names[f] in last):
                if store.exists(path(f)):
                    store.delete(path(f), True)
        return self.spark.createDataFrame([(reclaimed, len(touched))], "reclaimed long, buckets int")


class MemoryTier(NamedTuple):
    """A tier in memory: entries persisted up to a weight in bytes, those written last first; times to live don't count here."""

    entries: DataFrame

    @classmethod
    def of(cls, entries: DataFrame, most_bytes: int) -> MemoryTier:
        """Keep the latest of each key while their sizes sum to ``most_bytes`` at most."""
        held = put(empty(entries.sparkSession), entries).withColumn("m_size", F.length("value").cast("long"))
        order = [F.desc("written"), F.col("domain"), F.col("key")]
        dealt = in_ranges(held.select("domain", "key", "written", "m_size"), order, "memory-sizes")
        weighed, _ = with_total_before(dealt, "m_size")
        fit = weighed.where(F.col("o_before") + F.col("m_size") <= most_bytes).select("domain", "key")
        return cls(held.join(fit, ["domain", "key"], "left_semi").select(*_NAMES).persist(StorageLevel.MEMORY_ONLY))

    def get(self, domain: str, keys: DataFrame) -> DataFrame:
        return self.entries.where(F.col("domain") == domain).join(keys.select("key"), "key", "left_semi").select(*_NAMES)

    def drop(self) -> None:
        self.entries.unpersist()
