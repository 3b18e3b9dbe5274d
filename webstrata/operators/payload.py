"""Archived payloads: gzip record to WARC record, to HTTP response, to text; in Arrow batches."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from typing import Any, TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ParseError
from ..functions.fields import CHALLENGE_STATUS
from ..schema import HTTP_CAPTURE, WARC_RECORD

T = TypeVar("T")

#: HTTP headers of a response at most, and body bytes that the challenge test reads.
MAX_HEADERS, SNIPPET = 128, 4096
#: Bytes that a task decodes and passes on at once.
OUT_BYTES = 4 << 20
# Words of challenge pages.
CHALLENGE_WORDS = ("just a moment", "cf-challenge", "captcha")

_HEADER = pa.struct([("name", pa.string()), ("value", pa.string())])
_WARC = pa.struct([("headers", pa.list_(_HEADER)), ("body", pa.binary())])
_HTTP = pa.struct([("status", pa.int32()), ("headers", pa.list_(_HEADER)), ("body", pa.binary())])


def gunzip(data: bytes) -> bytes:
    """All members in a row; what follows the last one is left alone, plain data is given back."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data[:2] == b"\x1f\x8b":
        z = zlib.decompressobj(31)
        out.append(z.decompress(data) + z.flush())
        if not z.eof:
            raise ParseError("gzip data is cut short")
        data = z.unused_data
    return b"".join(out)


def values(column: pa.Array) -> Iterator[Any]:
    """Values of a column as Python's, one at a time."""
    return (x.as_py() for x in column)


def by_bytes(rows: Iterable[T], size: Callable[[T], int], most: int = OUT_BYTES) -> Iterator[tuple[int, list[T]]]:
    """(place of the first, rows) in runs that end once they have ``most`` bytes: so much is held at a time, however many rows come."""
    at, held, total = 0, [], 0
    for row in rows:
        held.append(row)
        total += size(row)
        if total >= most:
            yield at, held
            at, held, total = at + len(held), [], 0
    if held:
        yield at, held


def _headers(block: bytes) -> list[dict[str, str]]:
    rows = (line.partition(b":") for line in block.replace(b"\r\n", b"\n").split(b"\n")[1:])
    return [{"name": k.decode("utf-8", "replace").strip().lower(), "value": v.decode("utf-8", "replace").strip()} for k, sep, v in rows if sep]


def header_of(headers: list[dict[str, str]], name: str) -> str | None:
    return next((h["value"] for h in headers if h["name"] == name.lower()), None)


def parse_record(data: bytes, strict: bool = False) -> dict:
    """A WARC record.  The body runs to the end of the data, or for its declared length if ``strict``."""
    head, gap, body = gunzip(data).partition(b"\r\n\r\n")
    if not gap or not head.startswith(b"WARC/"):
        raise ParseError("no WARC record")
    headers = _headers(head)
    length = header_of(headers, "content-length")
    return {"headers": headers, "body": body[: int(length)] if strict and length and length.isdigit() else body}


def parse_response(block: bytes) -> dict:
    """An HTTP response: status, headers, raw body."""
    head, gap, body = block.partition(b"\r\n\r\n")
    first = head.split(b"\r\n", 1)[0].split(b" ")
    if not gap or not head.startswith(b"HTTP/") or len(first) < 2 or not first[1].isdigit():
        raise ParseError("no HTTP response")
    headers = _headers(head)
    if len(headers) > MAX_HEADERS:
        raise ParseError(f"more than {MAX_HEADERS} headers")
    return {"status": int(first[1]), "headers": headers, "body": body}


def body_bytes(http: dict) -> bytes:
    """The body, unzipped where its encoding says so."""
    return gunzip(http["body"]) if "gzip" in (header_of(http["headers"], "content-encoding") or "").lower() else http["body"]


#: Columns that decoding adds, and their types.
DECODED = {"record": WARC_RECORD, "http": HTTP_CAPTURE, "text": "string", "body": "binary"}
_ARROW = {"record": _WARC, "http": _HTTP, "text": pa.string(), "body": pa.binary()}


def decode_payloads(payloads: DataFrame, raw: str = "raw", strict: bool = False, on_error: str = "raise", parts: tuple[str, ...] = ("record", "http", "text")) -> DataFrame:
    """Adds ``parts`` and error to rows with a gzip (or plain) record in ``raw``.

    record: headers and block; http: status, headers, body as sent; body: its bytes, unzipped where
    its encoding says so; text: these as UTF-8, what isn't that replaced.  strict: a block ends with
    its declared length, else with the data, its end marks included.  Equal payloads should be
    reduced to one by digest before.  on_error: "raise", or "null" to keep the row with its error.
    A null payload gives nulls.
    """
    keep = [c for c in payloads.columns if c != raw]

    def one(data: bytes | None) -> tuple[dict, str | None]:
        if data is None:
            return {}, None
        try:
            record = parse_record(data, strict)
            http = parse_response(record["body"])
            body = body_bytes(http)
            return {"record": record, "http": http, "body": body, "text": body.decode("utf-8", "replace") if "text" in parts else None}, None
        except (ParseError, zlib.error) as e:
            if on_error == "raise":
                raise
            return {}, str(e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def size(row: tuple[dict, str | None]) -> int:
            made = row[0]
            return len(made["record"]["body"]) + len(made["body"]) if made else 0

        for batch in batches:
            for at, rows in by_bytes(map(one, values(batch.column(batch.num_columns - 1))), size):
                cols = [pa.array([made.get(p) for made, _ in rows], _ARROW[p]) for p in parts]
                kept = batch.slice(at, len(rows)).columns[:-1]
                yield pa.RecordBatch.from_arrays([*kept, *cols, pa.array([e for _, e in rows], pa.string())], names=[*keep, *parts, "error"])

    types = dict(payloads.dtypes)
    schema = ", ".join([f"`{c}` {types[c]}" for c in keep] + [f"{p} {DECODED[p]}" for p in parts] + ["error string"])
    return payloads.select(*keep, raw).mapInArrow(run, schema)


def unzipped_texts(bodies: DataFrame, body: str = "body") -> DataFrame:
    """``text`` in place of a body: unzipped if it is a gzip file, read as UTF-8; null for one that is broken."""
    keep = [c for c in bodies.columns if c != body]

    def one(data: bytes | None) -> str | None:
        try:
            return None if data is None else gunzip(data).decode("utf-8", "replace")
        except (ParseError, zlib.error):
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in by_bytes(map(one, values(batch.column(batch.num_columns - 1))), lambda text: len(text or "")):
                yield pa.RecordBatch.from_arrays([*batch.slice(at, len(texts)).columns[:-1], pa.array(texts, pa.string())], names=[*keep, "text"])

    types = dict(bodies.dtypes)
    return bodies.select(*keep, body).mapInArrow(run, ", ".join([*(f"`{c}` {types[c]}" for c in keep), "text string"]))


def header(headers: Column, name: str) -> Column:
    """The first value of a header, null without one."""
    return F.get(F.filter(headers, lambda h: h["name"] == name.lower()), F.lit(0))["value"]


def is_challenge(http: Column) -> Column:
    """Blocked status, or a guard's server with another status than 200, or its words in the first bytes of the raw body."""
    snippet = F.lower(F.decode(F.substring(http["body"], 1, SNIPPET), "ISO-8859-1"))
    guard = F.coalesce(F.contains(F.lower(header(http["headers"], "server")), F.lit("cloudflare")), F.lit(False))
    words = F.lit(False)
    for w in CHALLENGE_WORDS:
        words = words | F.contains(snippet, F.lit(w))
    return F.coalesce(http["status"].isin(*CHALLENGE_STATUS) | (guard & (http["status"] != 200)) | words, F.lit(False))


def once_per_digest(captures: DataFrame) -> DataFrame:
    """One locator for each payload digest: the first in (filename, offset) order."""
    return captures.groupBy("digest").agg(F.min(F.struct("filename", "offset", "length")).alias("at"), F.count(F.lit(1)).alias("captures")).select("digest", "at.*", "captures")


def missing(wanted: DataFrame, cached: DataFrame) -> DataFrame:
    """Digests that no cached payload has."""
    return wanted.join(cached.select("digest"), "digest", "left_anti")
