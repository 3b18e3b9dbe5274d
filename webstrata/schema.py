"""Relations of the engine.  The column order of CAPTURE is an output contract."""

from __future__ import annotations

from pyspark.sql import types as T

CAPTURE = T.StructType(
    [
        T.StructField("crawl", T.StringType(), False),
        T.StructField("urlkey", T.StringType(), False),
        T.StructField("url", T.StringType(), False),
        T.StructField("timestamp", T.TimestampType(), False),
        T.StructField("status", T.IntegerType(), False),
        T.StructField("mime", T.StringType()),
        T.StructField("mime_detected", T.StringType()),
        T.StructField("languages", T.ArrayType(T.StringType(), False), False),
        T.StructField("digest", T.StringType(), False),
        T.StructField("length", T.LongType(), False),
        T.StructField("offset", T.LongType(), False),
        T.StructField("filename", T.StringType(), False),
        T.StructField("redirect", T.StringType()),
        T.StructField("truncated", T.StringType()),
    ]
)
COLUMNS = tuple(CAPTURE.names)

#: Rows have no arrival order here: this is the order that "first" means everywhere.
TOTAL_ORDER = ("crawl_ord", "urlkey", "timestamp", "filename", "offset")

REGISTRY = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("name", T.StringType()),
        T.StructField("cdx-api", T.StringType()),
        T.StructField("from", T.StringType()),
        T.StructField("to", T.StringType()),
    ]
)

HEADERS = "array<struct<name: string, value: string>>"
#: Headers keep order and repeats; the first of a name counts.
WARC_RECORD = f"struct<headers: {HEADERS}, body: binary>"
HTTP_CAPTURE = f"struct<status: int, headers: {HEADERS}, body: binary>"
