"""Small column functions of captures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where payload files lie, before the file name.
PAYLOAD_BASE = "https://data.commoncrawl.org/"
# Statuses and URL parts of challenge pages.
CHALLENGE_STATUS = (403, 429, 503)
CHALLENGE_URL = ("/cdn-cgi/", "__cf_chl", "challenge")


def languages(csv: Column) -> Column:
    """Comma list to array, empties dropped, null to empty."""
    return F.filter(F.split(F.coalesce(csv, F.lit("")), ","), lambda x: x != "")


def warc_url(filename: Column) -> Column:
    return F.concat(F.lit(PAYLOAD_BASE), filename)


def range_header(offset: Column, length: Column) -> Column:
    """Inclusive byte range; null for an empty record."""
    return F.when(length > 0, F.concat(F.lit("bytes="), offset.cast("string"), F.lit("-"), (offset + length - 1).cast("string")))


def capture_key(crawl: Column, filename: Column, offset: Column) -> Column:
    return F.concat_ws(":", crawl, filename, offset.cast("string"))


def looks_like_challenge(status: Column, url: Column) -> Column:
    low = F.lower(F.coalesce(url, F.lit("")))
    found = status.isin(*CHALLENGE_STATUS)
    for part in CHALLENGE_URL:
        found = found | F.contains(low, F.lit(part))
    return F.coalesce(found, F.lit(False))


def stamp(timestamp: Column) -> Column:
    """14 digits."""
    return F.date_format(timestamp, "yyyyMMddHHmmss")


def parse_stamp(text: Column) -> Column:
    """14 digits to a UTC time; null if they aren't one."""
    return F.try_to_timestamp(text, F.lit("yyyyMMddHHmmss"))


def decode_entities(text: Column) -> Column:
    """The ampersand first, so ``&amp;lt;`` ends as ``<``."""
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def safe_name(text: Column) -> Column:
    return F.translate(text, "/:?&=", "_____")


def pages_of(body: Column) -> Column:
    """Page count of a probe body: a bare integer or JSON with ``pages``; anything else is 0."""
    number = F.regexp_extract(body, r"^\s*(\d+)\s*$", 1).try_cast("long")
    inner = F.regexp_extract(body, r'"pages"\s*:\s*(\d+)', 1).try_cast("long")
    return F.coalesce(number, inner, F.lit(0).cast("long"))


def backoff_ms(attempt: Column, base: int, most: int) -> Column:
    return F.least(F.lit(base) * F.pow(F.lit(2), attempt), F.lit(most)).cast("long")
