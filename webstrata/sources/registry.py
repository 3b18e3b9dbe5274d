"""The crawl list from an index server, kept in a cache tier for a while."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ParseError
from ..operators.cache import SCHEMA, CacheStore
from ..transport import Transport

# Where the public crawl list lies, and its fields.
REGISTRY_URL = "https://index.commoncrawl.org/collinfo.json"
FIELDS = ("id", "name", "cdx-api", "from", "to")
ROWS = "id string, name string, `cdx-api` string, `from` string, `to` string, crawl_ord int"


def parse_registry(spark: SparkSession, text: str) -> DataFrame:
    """A JSON array, newest crawl first, about one entry a month."""
    try:
        rows = [(*(row.get(f) for f in FIELDS), k) for k, row in enumerate(json.loads(text))]
    except (ValueError, AttributeError, TypeError) as e:
        raise ParseError(f"no crawl list: {e}") from e
    return spark.createDataFrame(rows, ROWS)


def live_registry(spark: SparkSession, transport: Transport, cache: CacheStore | None = None, ttl: int = 86_400, refresh: bool = False, url: str = REGISTRY_URL, now: float | None = None) -> DataFrame:
    """The crawl list; with a cache it is asked for only when the cached one is older than ``ttl`` seconds or ``refresh`` is set."""
    at = int(time.time() if now is None else now)
    if cache and not refresh:
        hit = cache.get("registry", spark.createDataFrame([(url,)], "key string"), F.lit(at)).first()
        if hit:
            return parse_registry(spark, bytes(hit["value"]).decode())
    text = transport.get_text(url)
    found = parse_registry(spark, text)
    if cache:
        cache.put(spark.createDataFrame([("registry", url, bytearray(text.encode()), at, ttl)], SCHEMA))
    return found
