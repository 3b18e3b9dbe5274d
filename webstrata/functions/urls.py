"""URL keys: host labels reversed, path and query in lower case, as Column and as literal."""

from __future__ import annotations

import re
from urllib.parse import quote

from pyspark.sql import Column
from pyspark.sql import functions as F

_SCHEME = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://"
_HOST = _SCHEME + r"(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/?#:@]+)"
_PATH = _SCHEME + r"[^/?#]*([^?#]*)"
_QUERY = r"^[^?#]*(\?[^#]*)"
_ADDRESS = r"^(?:\d{1,3}(?:\.\d{1,3}){3}|\[.*\])$"


def with_scheme(url: Column) -> Column:
    return F.when(url.rlike(_SCHEME), url).otherwise(F.concat(F.lit("http://"), url))


def surt(url: Column) -> Column:
    """Sort key of a URL: ``com,example)/path?query``.

    Scheme, userinfo, one leading ``www.``, port and fragment are dropped; addresses aren't
    reversed; an empty path is ``/``; text with no host is its own key in lower case; null is "".
    """
    trimmed = F.trim(F.coalesce(url, F.lit("")))
    full = with_scheme(trimmed)
    host = F.regexp_replace(F.lower(F.regexp_extract(full, _HOST, 1)), r"^www\.", "")
    labels = F.when(host.rlike(_ADDRESS), host).otherwise(F.array_join(F.reverse(F.split(host, r"\.")), ","))
    path = F.regexp_extract(full, _PATH, 1)
    key = F.concat(labels, F.lit(")"), F.lower(F.when(path == "", F.lit("/")).otherwise(path)), F.lower(F.regexp_extract(full, _QUERY, 1)))
    return F.when(host == "", F.lower(trimmed)).otherwise(key)


def surt_literal(url: str) -> str:
    """The same key on the driver, for patterns."""
    url = url.strip()
    full = url if re.search(_SCHEME, url) else "http://" + url
    m = re.search(_HOST, full)
    host = re.sub(r"^www\.", "", m.group(1).lower()) if m else ""
    if not host:
        return url.lower()
    labels = host if re.search(_ADDRESS, host) else ",".join(reversed(host.split(".")))
    path = re.search(_PATH, full)
    query = re.search(_QUERY, full)
    return f"{labels}){((path and path.group(1)) or '/').lower()}{query.group(1).lower() if query else ''}"


def reversed_host(pattern: str) -> str:
    """``com,example`` of any pattern that names a host."""
    return surt_literal(host_of(pattern)).split(")")[0]


def prefix_bounds(pattern: str) -> tuple[str, str]:
    """Half-open key range [lo, hi) of a URL prefix, for range filters that reach the scan."""
    lo = surt_literal(pattern)
    return lo, after_prefix(lo)


def after_prefix(text: str) -> str:
    """The least text behind all that start with ``text``; UTF-8 sorts as code points do.  "" has none: the largest character stands for it."""
    kept = text.rstrip("\U0010ffff")
    if not kept:
        return "\U0010ffff" * (len(text) + 1)
    point = ord(kept[-1]) + 1
    return kept[:-1] + chr(0xE000 if 0xD800 <= point < 0xE000 else point)


def host_of(pattern: str) -> str:
    """Host of a pattern, with its port; one ``www.`` stripped, lower case."""
    rest = pattern.partition("://")[2] if "://" in pattern else pattern
    return rest.removeprefix("www.").partition("/")[0].lower()


def tld_of(pattern: str) -> str:
    return host_of(pattern).rpartition(".")[2]


def host_name(url: Column) -> Column:
    """Host of a URL in lower case, as the columnar index has it, a leading ``www.`` included."""
    return F.lower(F.regexp_extract(with_scheme(url), _HOST, 1))


def host(url: Column) -> Column:
    return F.regexp_replace(host_name(url), r"^www\.", "")


def tld(urlkey: Column) -> Column:
    return F.split_part(F.split_part(urlkey, F.lit(")"), F.lit(1)), F.lit(","), F.lit(1))


def percent_encode(text: str) -> str:
    """All but unreserved characters as %XX."""
    return quote(text, safe="-_.~")


def sql_quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def stripped(url: Column) -> Column:
    """Without scheme and one ``www.``, as templates are matched."""
    return F.regexp_replace(F.regexp_replace(url, r"^.*?://", ""), r"^www\.", "")
