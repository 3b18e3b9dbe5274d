from __future__ import annotations

import re
from datetime import UTC, datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from webstrata import transport as tp
from webstrata.errors import ConfigError, HttpError, IndexTooLargeError, NotFoundError, ParseError, RateLimitedError
from webstrata.functions import fields, timespec, urls
from webstrata.operators import discover, payload
from webstrata.operators.budget import check_pages
from webstrata.plans import compile as plan
from webstrata.plans.crawls import CrawlSelector, year_of
from webstrata.plans.query import Collapse, Language, MatchType, Status, Tld, UrlQuery, UrlRegex
from webstrata.plans.template import UrlTemplate

NOW = datetime(2025, 3, 31, 9, 45, tzinfo=UTC)

SURT = [
    ("http://www.maps.rivers.org/elbe/Map", "org,rivers,maps)/elbe/map"),
    ("https://Rivers.ORG:8443/ODER", "org,rivers)/oder"),
    ("http://rivers.org", "org,rivers)/"),
    ("HTTPS://u:p@rivers.org:8080/x?B=1#f", "org,rivers)/x?b=1"),
    ("rivers.org/x|y z", "org,rivers)/x|y z"),
    ("http://10.0.0.1/a", "10.0.0.1)/a"),
    ("http://[::1]:80/a", "[::1])/a"),
    ("http://www.www.a.org?q", "org,a,www)/?q"),
    ("http://", "http://"),
    ("", ""),
]


def test_surt(spark):
    df = spark.createDataFrame([(u,) for u, _ in SURT], "u string").select("u", urls.surt(F.col("u")).alias("k"))
    got = {r["u"]: r["k"] for r in df.collect()}
    assert got == dict(SURT)
    assert {u: urls.surt_literal(u) for u, _ in SURT} == dict(SURT)


def test_surt_null(spark):
    assert spark.createDataFrame([(None,)], "u string").select(urls.surt(F.col("u")).alias("k")).first()["k"] == ""


def test_surt_column_is_literal(spark):
    parts = [["http://", "https://", "", "HTTP://"], ["", "a:b@", "www."], ["x.org", "A.b.Co", "1.2.3.4", ""], ["", ":80"], ["", "/", "/A b", "/%7e"], ["", "?Q=1", "?"], ["", "#f"]]
    every = [""]
    for p in parts:
        every = [a + b for a in every for b in p]
    df = spark.createDataFrame([(u,) for u in every], "u string").select("u", urls.surt(F.col("u")).alias("k"))
    assert all(r["k"] == urls.surt_literal(r["u"]) for r in df.collect())


@given(st.text(alphabet="abc/.", min_size=1, max_size=12), st.text(alphabet="abcz/?", max_size=6))
@settings(max_examples=100, deadline=None)
def test_prefix_bounds_hold_what_starts_with_them(prefix, rest):
    lo, hi = urls.prefix_bounds("example.com/" + prefix)
    key = urls.surt_literal("example.com/" + prefix) + rest
    assert lo <= key < hi
    assert not lo <= "com,example)" < hi


@given(st.text(min_size=1, max_size=4), st.text(max_size=4))
@settings(max_examples=300, deadline=None)
def test_after_prefix_bounds_exactly(prefix, other):
    hi = urls.after_prefix(prefix)
    for text in (prefix + other, other, prefix[:-1] + other):
        inside = prefix.encode() <= text.encode() < hi.encode()
        assert inside == text.startswith(prefix), (prefix, text, hi)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("2019", datetime(2019, 1, 1)), ("2019-08", datetime(2019, 8, 1)), ("2019-08-17", datetime(2019, 8, 17)), ("20190817", datetime(2019, 8, 17)), ("20190817224501", datetime(2019, 8, 17, 22, 45, 1)),
        ("2019-08-17T01:30:00-05:30", datetime(2019, 8, 17, 7)), ("2019-08-17t01:30:00z", datetime(2019, 8, 17, 1, 30)), ("2019-08-17T01:30:00", datetime(2019, 8, 17, 1, 30)), ("TODAY", datetime(2025, 3, 31)),
        ("yesterday", datetime(2025, 3, 30)), (" now ", datetime(2025, 3, 31, 9, 45)), ("5d", datetime(2025, 3, 26, 9, 45)), ("10 Days Ago", datetime(2025, 3, 21, 9, 45)), ("-1w", datetime(2025, 3, 24, 9, 45)),
        ("36 hrs", datetime(2025, 3, 29, 21, 45)), ("2y", datetime(2023, 3, 31, 9, 45)), ("4 mon", datetime(2024, 11, 30, 9, 45)),
    ],
)
def test_timespec(text, want):
    assert timespec.parse(text, NOW) == want.replace(tzinfo=UTC)


@pytest.mark.parametrize("text", ["next spring", "7 moons", "", "2019-14", "07", "99999999y"])
def test_timespec_rejects(text):
    with pytest.raises(ConfigError):
        timespec.parse(text, NOW)


def test_months_clamp_and_open_range():
    assert timespec.parse("1mo", datetime(2024, 3, 31, tzinfo=UTC)).day == 29
    assert timespec.parse_range(None, None) is None
    assert timespec.parse_range("2024", None, NOW) == (datetime(2024, 1, 1, tzinfo=UTC), NOW)


@pytest.mark.parametrize("text", ["all", "latest", "latest-6", "2020..2024", "CC-MAIN-2024-01,CC-MAIN-2023-05"])
def test_selector_round_trip(text):
    assert str(CrawlSelector.parse(text)) == text


def test_selector_errors_and_years():
    assert str(CrawlSelector.parse("since:2023-01-01")) == "since:2023-01-01"
    for bad in ("nothing", "latest-x", "a..b"):
        with pytest.raises(ConfigError):
            CrawlSelector.parse(bad)
    assert (year_of("CC-MAIN-2024-10"), year_of("x")) == (2024, None)


def test_registry_selection(spark):
    from webstrata.plans.crawls import resolve
    from webstrata.sources.captures import registry

    reg = registry(spark, [("CC-MAIN-2031-09", "2031-02-20T00:00:00", "2031-03-02T00:00:00"), ("CC-MAIN-2029-40", "2029-09-28T00:00:00", None), ("CC-MAIN-2027-21", None, "2027-05-30T00:00:00")])
    pick = lambda t: resolve(reg, CrawlSelector.parse(t))
    assert pick("since:2029-06-01") == ["CC-MAIN-2031-09", "CC-MAIN-2029-40"]
    assert pick("since:2031-03-02") == ["CC-MAIN-2031-09"] and pick("since:2031-03-03") == []
    assert pick("latest-2") == ["CC-MAIN-2031-09", "CC-MAIN-2029-40"]
    assert pick("2026..2030") == ["CC-MAIN-2029-40", "CC-MAIN-2027-21"]
    assert pick("CC-MAIN-2027-21,CC-MAIN-1990-01") == ["CC-MAIN-2027-21"]
    assert pick("latest-0") == [] and len(pick("all")) == 3 and pick("2031..2027") == []


def test_template(spark):
    t = UrlTemplate.parse("rivers.org/in/{land}/by/{river}")
    assert t.prefix == "rivers.org/in/"
    cases = {
        "https://www.rivers.org/in/cz/by/elbe?z=1/2": {"land": "cz", "river": "elbe?z=1/2"},
        "http://rivers.org/in/cz/by": None,
        "http://rivers.org/in//by/x": None,
    }
    df = spark.createDataFrame([(u,) for u in cases], "u string").select("u", t.bind(F.col("u")).alias("v"))
    assert {r["u"]: r["v"] for r in df.collect()} == cases
    more = [("{a}{b}", "xy", None), ("{a}/x", "q/xyz", {"a": "q"}), ("{a}-{a}", "1-2", {"a": "2"}), ("a.b/{v}", "axb/1", None)]
    for text, url, want in more:
        assert spark.createDataFrame([(url,)], "u string").select(UrlTemplate.parse(text).bind(F.col("u")).alias("v")).first()["v"] == want, text
    for bad in ("a/{x", "a/{}"):
        with pytest.raises(ConfigError):
            UrlTemplate.parse(bad)


def test_request_and_sql_text():
    q = UrlQuery.prefix("example.com/a b").status(200).where(Language("eng"), Tld("com"), UrlRegex("x+"), Status((301, 302)), Status(hundred=2)).collapsed(Collapse("timestamp", 10)).select("url", "mime_detected").take(5)
    url = plan.index_url("https://i/x", q, page=3)
    for part in ("url=example.com%2Fa%20b", "matchType=prefix", "filter=status%3A200", "filter=~status%3A%28301%7C302%29", "filter=~status%3A2..", "filter=languages%3Aeng", "filter=~url%3Ax%2B", "collapse=timestamp%3A10", "fl=url%2Cmime-detected", "limit=5", "page=3"):
        assert part in url
    sql = plan.sql_text(UrlQuery.host("https://www.o'x.com/").where(Language("e'g")), ["c1"])
    assert "url_surtkey >= 'com,o''x)' AND url_surtkey < 'com,o''x*'" in sql and "crawl IN ('c1')" in sql and "LIKE '%,e''g,%'" in sql
    assert "url_surtkey >= 'com,example)/a' AND url_surtkey < 'com,example)/b'" in plan.sql_text(UrlQuery.prefix("example.com/a"))
    assert " FALSE" in plan.sql_text(UrlQuery.prefix("example.com/a"), []) and "crawl IN" not in plan.sql_text(UrlQuery.prefix("example.com/a"))
    assert MatchType.parse("odd") is MatchType.PREFIX and Collapse.parse("odd").by == "digest" and Collapse.parse("timestamp:8").token == "timestamp:8"


def test_fields(spark):
    df = spark.createDataFrame([(500, 100, 403, "http://x/"), (0, 0, 200, "http://x/cdn-cgi/challenge"), (1, 1, 200, None)], "o long, l long, s int, u string")
    got = df.select(fields.range_header(F.col("o"), F.col("l")).alias("r"), fields.looks_like_challenge(F.col("s"), F.col("u")).alias("c")).collect()
    assert [(r["r"], r["c"]) for r in got] == [("bytes=500-599", True), (None, True), ("bytes=1-1", False)]
    one = spark.range(1).select(fields.decode_entities(F.lit("&amp;lt;&quot;")).alias("a"), fields.languages(F.lit("a,,b")).alias("b"), fields.safe_name(F.lit("sha1:A/b?c&d=e")).alias("c"), fields.backoff_ms(F.lit(3), 70, 900).alias("d"), fields.pages_of(F.lit('{"pages": 31}')).alias("e"), fields.pages_of(F.lit(" 12 ")).alias("f"), fields.pages_of(F.lit("no")).alias("g")).first()
    assert tuple(one) == ('<"', ["a", "b"], "sha1_A_b_c_d_e", 560, 31, 12, 0)


def test_discover(spark):
    df = spark.createDataFrame([("User-agent: *\nSITEMAP: https://e.com/s.xml \r\n sitemap:\n", "<loc> https://e.com/a?x=1&amp;y=2\n</loc><loc></loc><loc>b</loc><loc>open")], "r string, x string")
    got = df.select(discover.sitemap_lines(F.col("r")).alias("r"), discover.locations(F.col("x")).alias("x")).first()
    assert got["r"] == ["https://e.com/s.xml"] and got["x"] == ["https://e.com/a?x=1&y=2", "b"]


def test_payload_parsers():
    import gzip

    r = payload.parse_record(gzip.compress(b"WARC/1.1\r\nWARC-Type: metadata\r\nContent-Length: 7\r\n\r\nover: 1\r\n\r\n"))
    assert r["body"] == b"over: 1\r\n\r\n" and payload.header_of(r["headers"], "WARC-TYPE") == "metadata"
    assert payload.parse_record(b"WARC/1.1\r\nContent-Length: 7\r\n\r\nover: 1\r\n\r\n", strict=True)["body"] == b"over: 1"
    h = payload.parse_response(b"HTTP/1.0 410 Gone\r\nVia: /x\r\nA: 1\r\nA: 2\r\n\r\n")
    assert h["status"] == 410 and payload.header_of(h["headers"], "a") == "1"
    zipped = {"headers": [{"name": "content-encoding", "value": "gzip"}], "body": gzip.compress(b"x") + b"\r\n\r\n"}
    assert payload.body_bytes(zipped) == b"x"
    for bad in (b"no", b"HTTP/1.1 x\r\n\r\n"):
        with pytest.raises(ParseError):
            payload.parse_response(bad)
    with pytest.raises(ParseError):
        payload.parse_record(b"nothing")


def test_transport():
    assert [tp.backoff_ms(k, 70, 900) for k in range(6)] == [70, 140, 280, 560, 900, 900]
    for bad in ("", " User-Agent "):
        with pytest.raises(ConfigError):
            tp.user_agent(bad)
    assert [tp.pages_of(x) for x in (" 12", '{"pages": 31, "blocks": 9}', "x", "[1]", "-1")] == [12, 31, 0, 0, 0]
    t = tp.FixedTransport({"p0": "a\n\nb\n", "p1": "c\n", "n": "2"})
    assert [tp.lines_of(t, f"p{n}") for n in range(tp.num_pages(t, "n") + 1)] == [["a", "b"], ["c"], []]
    assert tp.num_pages(t, "zz") == 0 and t.get_range("p0", 0, 1) == b"a"
    with pytest.raises(NotFoundError):
        t.get_text("zz")
    with pytest.raises(IndexTooLargeError):
        check_pages({"c": 1001})


def test_retries():
    import io
    import urllib.error

    calls, slept = [], []

    def answers(*codes):
        it = iter(codes)

        def open_(req, timeout):
            calls.append(req)
            code = next(it)
            if code == 200:
                return io.BytesIO(b"ok")
            raise urllib.error.HTTPError("u", code, "", {"Retry-After": "7"} if code == 429 else {}, None)

        return open_

    polite = tp.Politeness(1000, clock=lambda: 0.0, sleep=slept.append)
    assert tp.HttpTransport("me", polite, opener=answers(503, 429, 200)).get_text("http://index.x/") == "ok"
    assert 7.0 in slept
    for codes, error in (((404,), NotFoundError), ((400,), HttpError), ((429,) * 6, RateLimitedError), ((500,) * 6, HttpError)):
        with pytest.raises(error):
            tp.HttpTransport("me", polite, opener=answers(*codes)).get_text("http://x/")


def test_escape_is_literal():
    for text in ("a.b*c", "x|y", "(z)", "\\d"):
        assert re.match(UrlTemplate.parse(text + "{v}").regex(), text + "1")
