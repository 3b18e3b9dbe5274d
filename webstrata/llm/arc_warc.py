"""Legacy archive converter: ARC version 1 and 2 records to WARC/1.1, and a WARC reader.

An ARC file is a sequence of ``header line, newline, <declared length> bytes, newline``.  The first
record is the version block; its body names the header fields of that version.  A converted record
gets an identifier derived from its content and address, a W3C date from the archive date, a type
from its scheme and status, and SHA-256 digests of block and payload.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

# Field order of ARC header lines, by version.
FIELDS = {
    1: ("url", "ip", "date", "type", "length"),
    2: ("url", "ip", "date", "type", "status", "checksum", "location", "offset", "filename", "length"),
}
#: Payloads shorter than this are never revisits.
LEAST_REVISIT = 100
#: Bytes of records that a legacy archive gathers before the next begins.
ARC_BYTES = 4 << 20
#: Groups of equal payloads that are broadcast at most, about 200 bytes each.
BROADCAST_GROUPS = 100_000


class ArcRecord(NamedTuple):
    version: int
    header: dict[str, str]
    body: bytes
    opens: bool = False  # the version block: a file's first record, if its url starts with filedesc:


def arc_version_block(version: int, name: str) -> bytes:
    body = f"{version} 0 webstrata\nURL IP-address Archive-date Content-type Archive-length\n"
    if version == 2:
        body = f"{version} 0 webstrata\nURL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n"
    rest = "200 - - 0 " + name + " " if version == 2 else ""
    return f"filedesc://{name} 0.0.0.0 20240101000000 text/plain {rest}{len(body)}\n{body}\n".encode()


def arc_url(url: str | None) -> str:
    """A url as header lines hold it: characters that would break them are percent-encoded; none is ``urn:none``."""
    return quote(url or "", safe="%/:=&?~#+!$,;'@()*[]|^{}\\\"<>`") or "urn:none"


def arc_date(page: int | None) -> str:
    """Archive date of a page, which the pages table doesn't have."""
    return f"{20240101000000 + (page or 0) % 60}"


def arc_record(version: int, url: str, date: str, status: int, body: bytes, name: str, offset: int) -> bytes:
    """One URL record."""
    safe = arc_url(url)
    rest = f"{status} - - {offset} {name} " if version == 2 else ""
    return f"{safe} 0.0.0.0 {date} text/html {rest}{len(body)}\n".encode() + body + b"\n"


def parse_arc(data: bytes) -> Iterator[ArcRecord]:
    """Records of one ARC file, the version block first.

    The version is the first number of the version block's body, or else told by the number of
    header fields.  A length that isn't a number or runs past the end raises ValueError.
    """
    at, version, opens = 0, 0, True
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError(f"header line at {at} doesn't end")
        parts = data[at:end].decode("utf-8", "replace").rstrip("\r").split(" ")
        mine = version or (2 if len(parts) >= len(FIELDS[2]) else 1)
        names = FIELDS[mine]
        extra = len(parts) - len(names)  # spaces inside the type field of old writers
        if extra < 0:
            raise ValueError(f"header line at {at} has {len(parts)} fields, version {mine} has {len(names)}")
        if extra:
            parts[3 : 4 + extra] = [" ".join(parts[3 : 4 + extra])]
        header = dict(zip(names, parts, strict=True))
        length = int(header["length"])
        if length < 0 or end + 1 + length > len(data):
            raise ValueError(f"record at {at} declares {length} bytes, {len(data) - end - 1} are left")
        body = data[end + 1 : end + 1 + length]
        opens = opens and header["url"].startswith("filedesc:")
        if opens:
            first = body.split(b" ", 1)[0]
            version = int(first) if first in (b"1", b"2") else mine
        yield ArcRecord(version or mine, header, body, opens)
        at, opens = end + 1 + length, False


def warc_date(date: str) -> str:
    """14 (or 12, 8) digits to a W3C date; missing parts are the earliest."""
    d = (date if date.isdigit() else "19700101000000").ljust(8, "0")[:14]
    d = d[:8] + d[8:].ljust(6, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def http_parts(body: bytes) -> tuple[dict[str, str], bytes]:
    """Lower-case headers (first of a name counts) and payload of an HTTP response block."""
    head, gap, payload = body.partition(b"\r\n\r\n")
    if not gap or not head.startswith(b"HTTP/"):
        return {}, body
    found: dict[str, str] = {}
    for line in head.split(b"\r\n")[1:]:
        k, _, v = line.decode("latin-1").partition(":")
        found.setdefault(k.strip().lower(), v.strip())
    return found, payload


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join(map(str, parts)))}>"


def warc_type(record: ArcRecord) -> str:
    if record.opens:
        return "warcinfo"
    return "response" if record.body.startswith(b"HTTP/") else "resource"


def to_warc(record: ArcRecord, first: ArcRecord | None = None, first_page: int | None = None, page: int | None = None) -> bytes:
    """A WARC/1.1 record equivalent to an ARC record.

    first: header of the record whose payload this one repeats, which makes it a revisit: the block
    keeps the HTTP headers alone, digest and length stay those of the full payload, and the
    record names the first one by identifier, address and date.  page: the id that
    ``WARC-Page-ID`` keeps.
    """
    kind = warc_type(record)
    _, payload = http_parts(record.body) if kind == "response" else ({}, record.body)
    block = record.body if first is None else record.body[: len(record.body) - len(payload)]
    digest = hashlib.sha256(payload).hexdigest()
    mime = {"response": "application/http; msgtype=response", "warcinfo": "application/warc-fields"}.get(kind, record.header["type"])
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if first else kind}",
        f"WARC-Record-ID: {record_id(record.header['url'], record.header['date'], digest, page)}",
        f"WARC-Date: {warc_date(record.header['date'])}",
        *([f"WARC-Target-URI: {record.header['url']}"] if kind != "warcinfo" else []),
        f"WARC-IP-Address: {record.header['ip']}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Payload-Length: {len(payload)}",
        *([f"WARC-Page-ID: {page}"] if page is not None else []),
    ]
    if first:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {record_id(first.header['url'], first.header['date'], digest, first_page)}",
            f"WARC-Refers-To-Target-URI: {first.header['url']}",
            f"WARC-Refers-To-Date: {warc_date(first.header['date'])}",
            *([f"WARC-Refers-To-Page: {first_page}"] if first_page is not None else []),
        ]
    lines += [f"Content-Type: {mime}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def members(blob: bytes) -> Iterator[bytes]:
    """Gzip members, each decompressed and checked."""
    while blob:
        z = zlib.decompressobj(31)
        yield z.decompress(blob) + z.flush()
        if not z.eof:
            raise ValueError("a gzip member is cut short")
        blob = z.unused_data


def parse_warc(data: bytes) -> tuple[dict[str, str], bytes]:
    """Lower-case named fields and block of one record; the block digest is verified where there is one."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not gap or not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    kind, _, said = fields.get("warc-block-digest", "").partition(":")
    if kind == "sha256" and said != hashlib.sha256(block).hexdigest():
        raise ValueError(f"block digest of {fields.get('warc-record-id')} differs")
    return fields, block


def with_revisits(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) with ``refers_to`` and ``refers_url``: the smallest page_id of equal payloads of 100 bytes or more and its url, null on that page itself.

    A null html counts as empty; rows that repeat the smallest page_id all stay responses (the
    smallest of their urls is referred to); a null page_id is never the smallest unless all are
    null, then all stay responses.  Only groups of equal payloads take part in the join: where they
    are few they are broadcast, otherwise pages too small to be revisits pass by it.
    """
    keyed = pages.select(
        F.col("page_id").cast("long"),
        F.col("url").cast("string"),
        F.coalesce(F.col("html"), F.lit("")).alias("html"),
    ).withColumn("digest", F.when(F.octet_length("html") >= LEAST_REVISIT, F.sha2("html", 256)))
    known = F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))
    first = keyed.where("digest is not null").groupBy(F.col("digest").alias("first_digest")).agg(F.min(known).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = stored(first.select("first_digest", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url")), "repeated")
    again = ~F.col("page_id").eqNullSafe(F.col("first_id"))
    marked = lambda df: df.select("page_id", "url", "html", F.when(again, F.col("first_id")).alias("refers_to"), F.when(again, F.col("first_url")).alias("refers_url"))
    if first.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS:
        return marked(keyed.join(F.broadcast(first), F.col("digest") == F.col("first_digest"), "left"))
    large = keyed.where("digest is not null").join(first, F.col("digest") == F.col("first_digest"), "left")
    small = keyed.where("digest is null").select("page_id", "url", "html", F.lit(None).cast("long").alias("refers_to"), F.lit(None).cast("string").alias("refers_url"))
    return marked(large).union(small)


PAGES = "array<struct<page_id: bigint, refers_to: bigint, refers_url: string>>"


def write_arcs(pages: DataFrame) -> DataFrame:
    """Legacy archives of (page_id, url, html, refers_to, refers_url): (arc, pages), gzip members one a record, and each record's ids.

    Files alternate between both ARC versions.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        version = 1
        kind = pa.list_(pa.struct([("page_id", pa.int64()), ("refers_to", pa.int64()), ("refers_url", pa.string())]))
        for batch in batches:
            ids, urls, htmls, refs, ref_urls = (batch.column(i) for i in range(5))
            at = 0
            while at < batch.num_rows:
                version, name = 3 - version, f"legacy-{at}.arc"
                legacy, kept, size, start = [gzip.compress(arc_version_block(version, name), 1, mtime=0)], [], 0, at
                while at < batch.num_rows and (size < ARC_BYTES or at == start):
                    page, html = ids[at].as_py(), htmls[at].as_py().encode("utf-8", "replace")
                    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n"
                    record = arc_record(version, urls[at].as_py() or "", arc_date(page), 200, head.encode() + html, name, size)
                    legacy.append(gzip.compress(record, 1, mtime=0))
                    kept.append({"page_id": page, "refers_to": refs[at].as_py(), "refers_url": ref_urls[at].as_py()})
                    size += len(record)
                    at += 1
                yield pa.RecordBatch.from_arrays([pa.array([b"".join(legacy)], pa.binary()), pa.array([kept], kind)], names=["arc", "pages"])

    return pages.select("page_id", "url", "html", "refers_to", "refers_url").mapInArrow(run, f"arc binary, pages {PAGES}")


def convert_arcs(arcs: DataFrame) -> DataFrame:
    """Legacy archives (arc[, pages]), plain or gzip, to gzip WARC blobs: (n_records, blob), a blob an archive.

    pages: ids of the URL records in order, where there are any; without them no record is a revisit.
    """
    named = "pages" in arcs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                raw = batch.column(0)[k].as_py()
                records = parse_arc(b"".join(members(raw)) if raw[:2] == b"\x1f\x8b" else raw)
                ids = iter((batch.column(1)[k].as_py() or []) if named else [])
                blob = []
                for record in records:
                    about = {} if record.opens else next(ids, {})
                    ref = about.get("refers_to")
                    first = ArcRecord(record.version, {"url": arc_url(about["refers_url"]), "date": arc_date(ref)}, b"") if ref is not None else None
                    blob.append(gzip.compress(to_warc(record, first, ref, about.get("page_id")), 1, mtime=0))
                yield pa.RecordBatch.from_pydict({"n_records": pa.array([len(blob)], pa.int64()), "blob": pa.array([b"".join(blob)], pa.binary())})

    return arcs.select("arc", *(["pages"] if named else [])).mapInArrow(run, "n_records long, blob binary")


def read_archives(blobs: DataFrame) -> DataFrame:
    """One row a record other than warcinfo: page id, type, payload length and digest, reference, identifiers.

    blob: gzip members one a record, as Spark's ``binaryFile`` source gives whole files too.  Digests
    of responses and resources are computed again; one that differs raises.  Fields that other
    writers leave out are null.  An empty or null blob has no rows.
    """
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "warc_date", "target_uri", "refers_to_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0):
                rows: list[tuple] = []
                for data in members(blob.as_py() or b""):
                    f, block = parse_warc(data)
                    kind = f.get("warc-type")
                    if kind == "warcinfo":
                        continue
                    said = f.get("warc-payload-digest", "")
                    n, digest = f.get("warc-payload-length"), said.rpartition(":")[2] or None
                    if kind in ("response", "resource"):
                        _, payload = http_parts(block)
                        n, seen = len(payload), hashlib.sha256(payload).hexdigest()
                        if said.startswith("sha256:") and seen != digest:
                            raise ValueError(f"payload digest of {f.get('warc-record-id')} differs")
                        digest = seen
                    page, ref = f.get("warc-page-id"), f.get("warc-refers-to-page")
                    number = lambda x: None if x is None else int(x)
                    rows.append((number(page), number(n), digest, kind, number(ref), f.get("warc-record-id"), f.get("warc-date"), f.get("warc-target-uri"), f.get("warc-refers-to")))
                if rows:
                    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), *[pa.string()] * 4)
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=list(names))

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, warc_date string, target_uri string, refers_to_id string"
    return blobs.select("blob").mapInArrow(run, schema)


def convert_pages(pages: DataFrame) -> DataFrame:
    """Write every page as a legacy record, store the archives, convert them, store the converted ones, read these back."""
    arcs = stored(write_arcs(with_revisits(pages)), "arc", compression="none")
    return read_archives(stored(convert_arcs(arcs), "warc", compression="none"))


ORACLE = """
with p as (select page_id, coalesce(html, '') html, octet_length(encode(coalesce(html, ''))) n, sha256(coalesce(html, '')) d from pages),
f as (select d, min(page_id) first_id from p where n >= 100 group by d)
select p.page_id, cast(p.n as bigint) payload_bytes, p.d payload_digest,
       case when f.first_id <> p.page_id then 'revisit' else 'response' end record_type,
       case when f.first_id <> p.page_id then f.first_id end refers_to
from p left join f on p.d = f.d and p.n >= 100
"""
