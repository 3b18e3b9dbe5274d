"""A URL query as Column predicates, as index request, as SQL text."""

from __future__ import annotations

from functools import reduce as fold

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.urls import percent_encode, prefix_bounds, reversed_host, sql_quote, surt_literal
from .query import FIELD_TOKENS, Filter, Language, MatchType, Mime, Status, Tld, UrlQuery, UrlRegex

#: Columns of the columnar index that SQL text selects.
TABLE_COLUMNS = (
    "url_surtkey, url, fetch_time, fetch_status, content_mime_type, content_mime_detected, content_languages, content_digest, "
    "warc_filename, warc_record_offset, warc_record_length, crawl"
)


def match_predicate(query: UrlQuery) -> Column:
    """On ``urlkey`` alone: equality, a range, or a range with a remainder, all of which scans evaluate on statistics."""
    key = F.col("urlkey")
    if query.match is MatchType.EXACT:
        return key == surt_literal(query.pattern)
    if query.match is MatchType.PREFIX:
        lo, hi = prefix_bounds(query.pattern)
        return (key >= lo) & (key < hi) & key.startswith(lo)
    rev = reversed_host(query.pattern)
    if query.match is MatchType.HOST:
        return (key >= rev + ")") & (key < rev + "*")
    return (key >= rev + ")") & (key < rev + "-") & (key.startswith(rev + ")") | key.startswith(rev + ","))


def filter_predicate(f: Filter) -> Column:
    match f:
        case Status(codes=None, hundred=int() as h):
            return F.col("status").between(h * 100, h * 100 + 99)
        case Status(codes=codes):
            found = F.col("status").isin(*codes) if codes else F.lit(False)
            return found | F.col("status").isNull() if 0 in (codes or ()) else found
        case Mime(value):
            return (F.col("mime") == value) | (F.col("mime_detected") == value)
        case Language(value):
            return F.array_contains("languages", value)
        case Tld(value):
            return F.col("urlkey").startswith(value.lower() + ",") | F.col("urlkey").startswith(value.lower() + ")")
        case UrlRegex(pattern):
            return F.col("url").rlike(pattern)
    raise TypeError(f"no filter: {f!r}")


def conditions(query: UrlQuery, crawls: list[str] | None = None) -> list[Column]:
    """A query's conditions but for its match; regular expressions come last.  crawls: ids the selector gave, none of them matches nothing, None is no condition."""
    parts = [] if crawls is None else [F.col("crawl").isin(*crawls) if crawls else F.lit(False)]
    if query.time_range:
        a, b = (F.lit(t.replace(tzinfo=None)).cast("timestamp_ntz") for t in query.time_range)
        inside = F.col("timestamp").between(a, b)
        # a time that isn't known is the epoch
        parts.append(inside | F.col("timestamp").isNull() if query.time_range[0].timestamp() <= 0 <= query.time_range[1].timestamp() else inside)
    return parts + [filter_predicate(f) for f in sorted(query.filters, key=lambda f: isinstance(f, UrlRegex))]


def predicate(query: UrlQuery, crawls: list[str] | None = None) -> Column:
    """All conditions of a query, for a where clause: rows with null for an answer don't match."""
    return fold(lambda a, b: a & b, conditions(query, crawls), match_predicate(query))


def index_filter(f: Filter) -> str:
    match f:
        case Status(codes=None, hundred=h):
            return f"~status:{h}.."
        case Status(codes=(one,)):
            return f"status:{one}"
        case Status(codes=codes):
            return f"~status:({'|'.join(map(str, codes or ()))})"
        case Mime(value):
            return f"mime:{value}"
        case Language(value):
            return f"languages:{value}"
        case Tld(value):
            return f"urlkey:{value},.*"
        case UrlRegex(pattern):
            return f"~url:{pattern}"
    raise TypeError(f"no filter: {f!r}")


def index_url(api: str, query: UrlQuery, **extra: object) -> str:
    """The request that asks an index server for the query (shown by dry runs)."""
    params: list[tuple[str, object]] = [("url", query.pattern), ("matchType", query.match.value), ("output", "json")]
    params += [("filter", index_filter(f)) for f in query.filters]
    if query.collapse:
        params.append(("collapse", query.collapse.token))
    if query.fields:
        params.append(("fl", ",".join(FIELD_TOKENS[c] for c in query.fields)))
    if query.time_range:
        params += [(k, f"{t:%Y%m%d%H%M%S}") for k, t in zip(("from", "to"), query.time_range, strict=True)]
    if query.limit is not None:
        params.append(("limit", query.limit))
    params += extra.items()
    return api + "?" + "&".join(f"{percent_encode(k)}={percent_encode(str(v))}" for k, v in params)


#: Index column of each capture column.
_INDEX_OF = {
    "crawl": "crawl", "urlkey": "url_surtkey", "url": "url", "timestamp": "fetch_time", "status": "fetch_status", "mime": "content_mime_type", "mime_detected": "content_mime_detected", "languages": "content_languages",
    "digest": "content_digest", "filename": "warc_filename", "offset": "warc_record_offset", "length": "warc_record_length",
}
_TEXT_ORDER = "crawl DESC, url_surtkey, fetch_time, warc_filename, warc_record_offset"


def sql_text(query: UrlQuery, crawls: list[str] | None = None, table: str = "ccindex") -> str:
    """A SELECT over the columnar index, with the meaning that ``predicate`` has where the index's columns allow it.

    crawls: None for every crawl; an empty list selects nothing.  Fields that the index lacks are
    left out; newer crawl ids come first, as there is no registry.
    """
    q = sql_quote
    parts = ["subset = 'warc'"]
    if crawls is not None:
        parts.append(f"crawl IN ({', '.join(map(q, crawls))})" if crawls else "FALSE")
    rev = reversed_host(query.pattern)
    if query.match is MatchType.HOST:
        parts.append(f"url_surtkey >= {q(rev + ')')} AND url_surtkey < {q(rev + '*')}")
    elif query.match is MatchType.DOMAIN:
        inside = " OR ".join(f"substr(url_surtkey, 1, {len(rev) + 1}) = {q(rev + end)}" for end in "),")
        parts.append(f"url_surtkey >= {q(rev + ')')} AND url_surtkey < {q(rev + '-')} AND ({inside})")
    elif query.match is MatchType.PREFIX:
        lo, hi = prefix_bounds(query.pattern)
        parts.append(f"url_surtkey >= {q(lo)} AND url_surtkey < {q(hi)}")
    else:
        parts.append(f"url_surtkey = {q(surt_literal(query.pattern))}")
    if query.time_range:
        a, b = (f"TIMESTAMP '{t:%Y-%m-%d %H:%M:%S}'" for t in query.time_range)
        parts.append(f"fetch_time BETWEEN {a} AND {b}")
    for f in query.filters:
        match f:
            case Status(codes=None, hundred=int() as h):
                parts.append(f"fetch_status >= {h * 100} AND fetch_status < {h * 100 + 100}")
            case Status(codes=(one,)):
                parts.append(f"fetch_status = {one}")
            case Status(codes=codes):
                parts.append(f"fetch_status IN ({', '.join(map(str, codes))})" if codes else "FALSE")
            case Mime(value):
                parts.append(f"(content_mime_type = {q(value)} OR content_mime_detected = {q(value)})")
            case Language(value):
                parts.append(f"concat(',', content_languages, ',') LIKE {q(f'%,{value},%')}")
            case Tld(value):
                parts.append(f"url_surtkey >= {q(value.lower() + ')')} AND url_surtkey < {q(value.lower() + '-')} AND (url_surtkey LIKE {q(value.lower() + ',%')} OR url_surtkey LIKE {q(value.lower() + ')%')})")
            case UrlRegex(pattern):
                parts.append(f"REGEXP_LIKE(url, {q(pattern)})")
    columns = ", ".join(_INDEX_OF[c] for c in query.fields if c in _INDEX_OF) if query.fields else TABLE_COLUMNS
    where = f"FROM {table} WHERE {' AND '.join(parts)}"
    if query.collapse:
        stamp = f"substr(date_format(fetch_time, 'yyyyMMddHHmmss'), 1, {query.collapse.digits})"
        key = {"digest": "content_digest", "urlkey": "url_surtkey", "timestamp": f"url_surtkey, {stamp}"}[query.collapse.by]
        where = f"FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {_TEXT_ORDER}) AS pick {where}) WHERE pick = 1"
    return f"SELECT {columns} {where}" + (f" ORDER BY {_TEXT_ORDER} LIMIT {query.limit}" if query.limit is not None else "")
