from __future__ import annotations

import json
import pickle
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from webstrata import derived, sinks
from webstrata.api import Archive, Settings
from webstrata.cli import main, parser, rendered, run
from webstrata.errors import BudgetExhaustedError, ConfigError, IndexTooLargeError, NotFoundError, ParseError
from webstrata.operators import budget, cache, payload, reduce, sampling
from webstrata.operators.ordered import leading_rows
from webstrata.operators.sampling import Sampling, sample
from webstrata.plans.query import MatchType, UrlQuery
from webstrata.queries import page_records
from webstrata.schema import CAPTURE, COLUMNS
from webstrata.sources import captures as src
from webstrata.sources import ranges
from webstrata.sources.paged import read_pages, requests_of
from webstrata.sources.ranges import read_ranges
from webstrata.sources.registry import REGISTRY_URL, live_registry
from webstrata.streaming import captures as streams
from webstrata.transport import FixedTransport, HttpTransport, Politeness, answer_name


def timeline(spark, digests, key="k"):
    rows = [(key, datetime.fromtimestamp(i), d, "f", i) for i, d in enumerate(digests)]
    return spark.createDataFrame(rows, "urlkey string, timestamp timestamp, digest string, filename string, offset long")


def offsets(df):
    return sorted(r["offset"] for r in df.collect())


@pytest.mark.parametrize(
    ("policy", "most", "digests", "want"),
    [
        ("unique-digest", 8, "pqpqr", [0, 1, 4]), ("first-last", 8, "ppqp", [0, 3]), ("first-last", 8, "q", [0]), ("first-last-digest", 8, "pppqqp", [0, 3, 5]), ("first-last-digest", 8, "pqqpp", [0, 1, 3, 4]),
        ("first-last-digest", 8, "ppppp", [0, 4]), ("adaptive", 4, "pqrstuv", [0, 2, 4, 6]), ("adaptive", 1, "pqr", [0]), ("adaptive", 0, "pqrs", [0, 1, 2, 3]), ("adaptive", 2, "ppqqq", [0, 4]), ("all", 8, "ppq", [0, 1, 2]),
    ],
)
def test_sampling(spark, policy, most, digests, want):
    assert offsets(sample(timeline(spark, digests), Sampling(policy, most))) == want


def test_adaptive_is_even(spark):
    r = random.Random(1)
    for n, most in [(r.randrange(2, 40), r.randrange(2, 12)) for _ in range(6)]:
        want = list(range(n)) if n <= most else sorted({i * (n - 1) // (most - 1) for i in range(most)})
        assert offsets(sample(timeline(spark, [str(i) for i in range(n)]), Sampling("adaptive", most))) == want


def brute_sample(rows, policy, most):
    """rows: (key, time, crawl order, file, offset, digest) of any keys."""
    kept = []
    for key in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: r[1:5])
        n = len(mine)
        if policy == "first-last":
            kept += [r for k, r in enumerate(mine) if k in (0, n - 1)]
            continue
        changes = [r for k, r in enumerate(mine) if k in (0, n - 1) or r[5] != mine[k - 1][5]]
        m = len(changes)
        if policy == "adaptive" and most == 1:
            changes = changes[:1]
        elif policy == "adaptive" and 1 < most < m:
            changes = [changes[i] for i in sorted({i * (m - 1) // (most - 1) for i in range(most)})]
        kept += changes
    return sorted(map(str, kept))


@pytest.mark.parametrize(("seed", "keys"), [(1, ["hot"]), (2, ["a", "hot", "z", None]), (3, [f"k{i}" for i in range(300)])])
@pytest.mark.parametrize(("policy", "most"), [("first-last", 8), ("first-last-digest", 8), ("adaptive", 1), ("adaptive", 0), ("adaptive", 7)])
def test_sampling_over_the_edges_of_ranges(spark, seed, keys, policy, most):
    r = random.Random(seed)
    key = lambda: "hot" if "hot" in keys and r.random() < 0.9 else r.choice(keys)
    digest = lambda k: r.choice(["p", "q", None]) if k % 50 < 10 else "p"
    rows = [(key(), datetime.fromtimestamp(r.randrange(400)), r.randrange(3), r.choice("fg"), k, digest(k)) for k in range(900)]
    table = spark.createDataFrame(rows, "urlkey string, timestamp timestamp, crawl_ord int, filename string, offset long, digest string").repartition(3)
    spark.conf.set("spark.sql.shuffle.partitions", 23)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sample(table, Sampling(policy, most), ordered=False)
        assert sorted(map(str, map(tuple, got.collect()))) == brute_sample(rows, policy, most)
        marked = sampling.in_marked_ranges(table, ["timestamp", "crawl_ord", "filename", "offset"], ends_only=False)
        if "hot" in keys:
            assert marked.where("urlkey = 'hot'").select("s_part").distinct().count() > 12
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_sampling_of_nothing(spark):
    for policy in ("first-last", "adaptive", "unique-digest", "all"):
        assert sample(timeline(spark, ["p"]).limit(0), Sampling(policy)).count() == 0


def test_large_limits_have_no_single_task(spark):
    rows = spark.range(5000).select(F.lit(0).alias("crawl_ord"), F.md5(F.col("id").cast("string")).alias("urlkey"), F.lit(datetime(2024, 1, 1)).alias("timestamp"), F.lit("f").alias("filename"), F.col("id").alias("offset"))
    order = reduce.total_order(rows)
    want = [r["offset"] for r in rows.orderBy(*order).collect()]
    for n in (0, 1, 7, 2500, 4999, 5000, 9000):
        got = leading_rows(rows, order, n, top=5)
        assert [r["offset"] for r in got.collect()] == want[:n]
    plan = leading_rows(rows, order, 2500, top=5)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "SinglePartition" not in plan and "Limit" not in plan
    assert leading_rows(rows.limit(0), order, 9, top=5).count() == 0


def scan_of(df):
    """(pushed filters, partition filters, columns read) of a plan's Parquet scan."""
    text = df._jdf.queryExecution().executedPlan().toString()
    text = next(x for x in text.splitlines() if "FileScan parquet" in x and "url_surtkey" in x)
    part = lambda name: text.split(name + ": ")[1]
    return part("PushedFilters").split("], ReadSchema")[0], part("PartitionFilters").split("], PushedFilters")[0], part("ReadSchema")


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory, sf_dir):
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    root = str(tmp_path_factory.mktemp("index"))
    src.write_index(derived.captures(spark, sf_dir), root)
    yield Archive.of_index(spark, root, derived.crawls(spark))
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_index_scan_pushes_filters(spark, sf_dir, index):
    assert src.partition_path("CC-MAIN-2021-04").endswith("crawl=CC-MAIN-2021-04/subset=warc")
    whole = Archive(spark, derived.captures(spark, sf_dir), derived.crawls(spark))
    start, end = datetime(2024, 1, 25, 6), datetime(2024, 1, 30)
    query = UrlQuery.domain("example.com").status(200).mime("text/html").between(start, end).in_crawls("latest").select("url", "offset")
    got = index.search(query)
    assert got.count() > 0 and sorted(map(str, got.collect())) == sorted(map(str, whole.search(query).collect()))
    pushed, partitions, columns = scan_of(got)
    for want in ("GreaterThanOrEqual(url_surtkey,com,example))", "LessThan(url_surtkey,com,example-)", "EqualTo(fetch_status,200)", "GreaterThanOrEqual(fetch_time,2024-01-25", "LessThanOrEqual(fetch_time,2024-01-30", "EqualTo(content_mime_detected,text/html)"):
        assert want in pushed, want
    assert "subset" in partitions and "crawl" in partitions
    assert "warc_record_offset" in columns and "warc_filename" not in columns and "content_languages" not in columns
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    ("query", "want"),
    [
        (UrlQuery.exact("example.com/a"), "EqualTo(url_surtkey,com,example)/a)"), (UrlQuery.prefix("example.com/a"), "StringStartsWith(url_surtkey,com,example)/a)"), (UrlQuery.host("example.com"), "LessThan(url_surtkey,com,example*)"),
        (UrlQuery.host("example.com").status_class(3), "GreaterThanOrEqual(fetch_status,300)"), (UrlQuery.host("example.com").status(1, 2), "In(fetch_status, [1,2])"),
    ],
)
def test_every_match_reaches_the_files(index, query, want):
    assert want in scan_of(index.search(query))[0]


def test_index_rows_with_nulls(spark):
    rows = [(None, "u", None, None, "c"), ("com,a)/", "v", datetime(2024, 1, 2), 200, "c")]
    table = spark.createDataFrame(rows, "url_surtkey string, url string, fetch_time timestamp, fetch_status int, crawl string")
    archive = Archive(spark, src.from_index(table), src.registry(spark, [("c", None, None)]))
    assert archive.search(UrlQuery.host("a.com")).count() == 1 and archive.search(UrlQuery.host("a.com").status(0)).count() == 0
    filled = src.with_defaults(src.from_index(table)).where("url = 'u'").first()
    assert (filled["urlkey"], filled["status"], filled["timestamp"].timestamp(), filled["length"]) == ("", 0, 0, 0)


def test_byte_budget_over_many_partitions(spark, sf_dir):
    c = derived.captures(spark, sf_dir).cache()
    lengths = [r["length"] for r in c.orderBy(*reduce.total_order(c)).select("length").collect()]
    spark.conf.set("spark.sql.shuffle.partitions", 17)
    try:
        for n in (0, 1, 500, 999, 1000):
            assert budget.within_bytes(c, sum(lengths[:n])).count() == n
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_sinks_round_trip(spark, sf_dir, tmp_path):
    c = derived.captures(spark, sf_dir).limit(20).withColumn("timestamp", F.date_trunc("second", "timestamp")).cache()
    path = str(tmp_path / "m")
    sinks.ndjson(c).write.text(path)
    back = src.read_manifest(spark, path)
    assert back.columns == list(COLUMNS) == CAPTURE.names
    assert sorted(map(str, back.collect())) == sorted(map(str, c.select(*COLUMNS).withColumn("timestamp", F.col("timestamp").cast("timestamp")).collect()))
    assert next(rendered(c, "csv")) == "crawl,timestamp,status,url,digest,filename,offset,length"
    assert sinks.csv_rows(c.withColumn("url", F.lit('a,"b'))).first()["value"].split(",", 3)[3].startswith('"a,""b",')
    assert sinks.table_rows(c).first()["value"][16] == " "


def test_index_lines(spark):
    # The names of an index line's fields; all are strings.
    fields = {"urlkey": "org,rivers)/map?z=2", "timestamp": "20220519083041", "url": "http://rivers.org/map?z=2", "mime": "text/plain", "mime-detected": "text/html", "status": "302", "digest": "sha1:Q7", "length": "88", "offset": "901", "filename": "crawl-data/r.warc.gz", "languages": "deu,fra", "redirect": "/maps"}
    row = src.parse_lines(spark.createDataFrame([(json.dumps(fields),), ("  ",)], "value string"), "c").first()
    assert (row["status"], row["length"], row["offset"], row["languages"], row["redirect"], row["truncated"]) == (302, 88, 901, ["deu", "fra"], "/maps", None)
    poor = src.parse_lines(spark.createDataFrame([('{"timestamp":"20220519083041","status":"x","length":"-5"}',)], "value string"), "c").first()
    assert (poor["urlkey"], poor["status"], poor["length"], poor["languages"]) == ("", 0, 0, [])
    bad = spark.createDataFrame([("{}",), ("nope",)], "value string")
    assert src.parse_lines(bad, "c", "PERMISSIVE").where("_corrupt is not null").count() == 2
    with pytest.raises(Exception, match="bad index line"):
        src.parse_lines(bad, "c").collect()


def test_budget(spark, sf_dir):
    c = derived.captures(spark, sf_dir).limit(30).cache()
    rows, over = budget.spend(c, budget.Budget(records=2))
    assert rows.count() == 2 and isinstance(over, BudgetExhaustedError) and over.resume.startswith("CC-MAIN")
    rest = reduce.resume_after(c, over.resume)
    assert rest.count() == 28 and rest.exceptAll(c.exceptAll(rows)).count() == 0
    key = over.resume.split("@")[0]
    assert "@" in over.resume and reduce.resume_after(c, key).exceptAll(rest).count() == 0 == rest.exceptAll(reduce.resume_after(c, key)).count()
    bare = c.drop("crawl_ord")
    assert reduce.resume_after(bare, budget.spend(bare, budget.Budget(records=5))[1].resume).count() == 25
    for bad in ("nothing", "CC-MAIN-2024-04:f:99999"):
        with pytest.raises(ConfigError):
            reduce.resume_after(c, bad)
    assert budget.spend(c, budget.Budget(records=30))[1] is None and budget.spend(c, budget.Budget())[1] is None
    with pytest.raises(IndexTooLargeError):
        budget.spend(c, budget.Budget(pages=3), {"a": 4})
    none, over = budget.spend(c, budget.Budget(records=9, bytes=0))
    assert none.count() == 0 and over.what == "byte" and over.resume is None
    ordered = [r["length"] for r in reduce.ordered_limit(c, 30).collect()]
    most = sum(ordered[:7])
    assert budget.within_bytes(c, most).count() == 7
    assert budget.spend(c, budget.Budget(bytes=most))[1].what == "byte"
    assert reduce.newest(c).count() == reduce.oldest(c).count() == 1


def test_payload_ranges_and_text(spark, sf_dir, tmp_path):
    recs = page_records(spark, sf_dir).orderBy("page_id").limit(5).collect()
    data, spots = b"", []
    for r in recs:
        spots.append((f"d{r['page_id']}", "seg/a.warc.gz", len(data), len(r["raw"])))
        data += bytes(r["raw"])
    (tmp_path / "seg").mkdir()
    (tmp_path / "seg" / "a.warc.gz").write_bytes(data)
    spots += [("long", "seg/a.warc.gz", len(data) - 3, 9), ("far", "seg/a.warc.gz", len(data) + 5, 2), ("none", "seg/b.warc.gz", 0, 9), ("null", None, 0, 9), ("empty", "seg/a.warc.gz", 4, 0)]
    got = read_ranges(str(tmp_path), spark.createDataFrame(spots, "digest string, filename string, offset long, length long"))
    failed = {r["digest"]: r["error"] for r in got.where("error is not null").collect()}
    assert set(failed) == {"long", "far", "none", "null"} and failed["long"].startswith("3 of 9 bytes") and got.where("digest = 'empty'").first()["raw"] == b""
    got = got.where("length(raw) > 0").drop("error")
    text = {r["digest"]: r["text"] for r in payload.decode_payloads(got, strict=True).collect()}
    html = {f"d{r['page_id']}": r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    assert text == {k: html[k] for k in text} and len(text) == 5
    broken = spark.createDataFrame([("x", b"junk"), ("y", None)], "digest string, raw binary")
    assert {r["digest"]: r["error"] for r in payload.decode_payloads(broken, on_error="null").collect()} == {"x": "no WARC record", "y": None}


def test_ranges_are_joined_and_packed_by_bytes(spark, sf_dir, tmp_path):
    recs = page_records(spark, sf_dir).orderBy("page_id").collect()
    data, spots = b"", []
    for k, r in enumerate(recs):
        data += b"x" * (5_000 if k % 10 == 9 else k % 3)  # what lies between records
        spots.append((f"d{k}", "big.warc.gz", len(data), len(r["raw"])))
        data += bytes(r["raw"])
    (tmp_path / "big.warc.gz").write_bytes(data)
    spots += [("inside", "big.warc.gz", spots[3][2] + 5, 7), ("again", "big.warc.gz", *spots[4][2:])]
    given = spark.createDataFrame(spots, "digest string, filename string, offset long, length long").repartition(3)
    gap, slab, share = 1_000, 5_000, 8_000
    planned, tasks = ranges.packed(ranges.reads(given, gap, slab), share)
    rows = planned.collect()
    found = {(r["r_start"], r["r_stop"]) for r in rows}
    most = max(r["length"] for r in rows)
    by_task = {}
    for r in {(r["r_task"], r["r_start"], r["r_stop"]) for r in rows}:
        by_task[r[0]] = by_task.get(r[0], 0) + r[2] - r[1]
    assert len(rows) == len(spots) and len(found) < len(spots) / 2 and sum(r["r_first"] for r in rows) == len(found)
    assert len(by_task) > 5 and max(by_task) < tasks and max(by_task.values()) <= share + slab + most
    assert all(r["r_start"] <= r["offset"] and r["offset"] + r["length"] <= r["r_stop"] <= r["r_start"] + slab + most for r in rows)
    for kw in ({}, {"gap": gap, "slab": slab, "task_bytes": share}, {"gap": 0, "slab": 1, "task_bytes": 1}):
        got = {r["digest"]: bytes(r["raw"]) for r in read_ranges(str(tmp_path), given, **kw).collect()}
        assert got == {d: data[o : o + n] for d, _, o, n in spots}
    assert read_ranges(str(tmp_path), given.limit(0)).count() == 0
    # one request a read, and the bytes that a failed read holds are asked for one by one
    web = FailingTransport(str(tmp_path / "asked"), str(tmp_path))
    got = read_ranges("https://data", given, web, 2, gap=gap, slab=slab).collect()
    asked = (tmp_path / "asked").read_text().split()
    assert all(bytes(r["raw"]) == data[o : o + n] for r in got for d, _, o, n in spots if d == r["digest"]) and len(got) == len(spots)
    assert len(asked) < len(found) + 40


class FailingTransport:
    """Fails for requests that begin with the file and are long; writes down all."""

    def __init__(self, log, root):
        self.log, self.root = log, root

    def get_range(self, url, start, length):
        with open(self.log, "a") as f:
            f.write(f"{start}-{length}\n")
        if start == 0 and length > 4_000:
            raise ParseError("no")
        with open(f"{self.root}/{url.rpartition('/')[2]}", "rb") as f:
            f.seek(start)
            return f.read(length)


def test_bodies_keep_their_bytes(spark):
    import gzip

    image = bytes(range(256))
    for zipped in (False, True):
        head = b"HTTP/1.1 200 OK\r\n" + (b"Content-Encoding: gzip\r\n" if zipped else b"") + b"\r\n"
        block = head + (gzip.compress(image) if zipped else image)
        record = gzip.compress(b"WARC/1.0\r\nContent-Length: " + str(len(block)).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")
        rows = spark.createDataFrame([(record,)], "raw binary")
        assert bytes(payload.decode_payloads(rows, strict=True, parts=("body",)).first()["body"]) == image
        loose = bytes(payload.decode_payloads(rows, parts=("body", "text")).first()["body"])
        assert loose == (image if zipped else image + b"\r\n\r\n")


def archive_with_payloads(spark):
    import gzip

    def record(body, kind="text/html"):
        block = f"HTTP/1.1 200 OK\r\nContent-Type: {kind}\r\n\r\n{body}".encode()
        return gzip.compress(f"WARC/1.0\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block)

    site = {
        "https://ex.com/robots.txt": "Sitemap: https://ex.com/s1.xml\n",
        "https://ex.com/s1.xml": "<loc>https://ex.com/a</loc><loc>https://ex.com/b</loc>",
        "https://ex.com/a": "old",
    }
    rows, raws = [], []
    for i, (u, body) in enumerate(site.items()):
        rows.append(("CC-MAIN-2024-04", "", u, datetime(2024, 1, 26), 200, "t", "t", ["eng"], f"g{i}", 1, i, "f", None, None))
        raws.append((f"g{i}", record(body)))
    rows.append(("CC-MAIN-2024-04", "", "https://ex.com/a", datetime(2024, 1, 27), 200, "t", "t", [], "g9", 1, 9, "f", None, None))
    rows.append(("CC-MAIN-2024-04", "", "https://ex.com/a", datetime(2024, 1, 28), 404, "t", "t", [], "g9", 1, 10, "f", None, None))
    raws.append(("g9", record("new")))
    from webstrata.functions.urls import surt

    captures = spark.createDataFrame(rows, CAPTURE).withColumn("urlkey", surt(F.col("url")))
    return Archive(spark, captures, derived.crawls(spark), spark.createDataFrame(raws, "digest string, raw binary"))


def test_archive(spark):
    a = archive_with_payloads(spark)
    urls = spark.createDataFrame([("http://www.ex.com/a",), ("http://ex.com/none",)], "url string")
    assert [(r["url"], r["text"]) for r in a.text(urls).collect()] == [("http://www.ex.com/a", "new")]
    assert [r["url"] for r in a.sitemap_seeds("ex.com").collect()] == ["https://ex.com/a", "https://ex.com/b", "https://ex.com/s1.xml", "https://ex.com/sitemap.xml"]
    e = a.enumerate("ex.com", MatchType.DOMAIN).distinct_urls().status(200).budget(budget.Budget(records=2))
    assert e.run().count() == 2 and e.run_all()[1] is not None
    bound = a.enumerate_template("ex.com/{name}.{ext}", "latest").collect()
    assert {tuple(sorted(r["vars"].items())) for r in bound} == {(("ext", "txt"), ("name", "robots")), (("ext", "xml"), ("name", "s1"))}
    assert a.manifest(UrlQuery.exact("ex.com/a")).count() == 3
    assert any("matchType=domain" in x for x in a.dry_run(UrlQuery.domain("ex.com").in_crawls("latest")))


def test_command_line(spark):
    a = archive_with_payloads(spark)
    lines = lambda *argv: list(run(parser().parse_args(argv), a))
    assert len(lines("search", "ex.com", "--match", "domain")) == 5
    assert len(lines("--output", "csv", "search", "ex.com/a", "--match", "exact", "--status", "200")) == 3
    assert lines("text", "https://ex.com/a") == ["new"]
    assert len(lines("sitemap", "ex.com")) == 4
    assert len(lines("--newest", "search", "ex.com")) == 1
    assert len(lines("manifest", "ex.com/a", "--sample", "first-last")) == 2
    assert len(lines("crawls")) == 1 and '"captures":5' in lines("stats", "ex.com", "--captures")[0]
    assert len(lines("enumerate", "--template", "ex.com/{x}")) == 5
    assert "SELECT" in lines("--dry-run", "search", "ex.com")[-1]
    with pytest.raises(BudgetExhaustedError) as over:
        lines("--budget", "1", "enumerate", "ex.com", "--distinct-urls")
    assert len(lines("--resume", over.value.resume, "enumerate", "ex.com", "--distinct-urls", "--bulk")) == 2
    assert main(["crawls"]) == 2


def test_command_line_fetch(spark, tmp_path, capsys):
    a = archive_with_payloads(spark)
    lines = lambda *argv: list(run(parser().parse_args(argv), a))
    out = tmp_path / "out"
    assert lines("fetch", "https://ex.com/a", "--out", str(out)) == ["g9\t3"] and (out / "g9").read_bytes() == b"new"
    assert lines("fetch", "https://ex.com/a", "--text") == ["new"]
    sinks.ndjson(a.captures).coalesce(1).write.text(str(tmp_path / "m"))
    assert sorted(lines("fetch", f"@{tmp_path / 'm'}", "--text")) == sorted(["new", "new", "old", "Sitemap: https://ex.com/s1.xml\n", "<loc>https://ex.com/a</loc><loc>https://ex.com/b</loc>"])
    with pytest.raises(NotFoundError):
        lines("fetch", "https://ex.com/none")
    a.payloads = a.payloads.where("digest <> 'g9'")
    with pytest.raises(ParseError, match="1 payloads failed"):
        lines("text", "https://ex.com/a")
    assert "no payload in any store" in capsys.readouterr().err


def test_command_line_pages(spark, tmp_path):
    a = archive_with_payloads(spark)
    a.settings = Settings(answers=str(tmp_path))
    query = UrlQuery.prefix("ex.com").in_crawls("latest")
    ((crawl, url),) = requests_of(query, [(r["id"], r["cdx-api"]) for r in a.crawls("latest").collect()]).items()
    line = json.dumps({"urlkey": "com,ex)/q", "timestamp": "20240126000000", "url": "http://ex.com/q", "status": "200", "digest": "d", "length": "5", "offset": "0", "filename": "f"})
    for tail, body in (("&showNumPages=true", "3"), ("&page=0", line + "\n\n" + line), ("&page=2", line)):
        (tmp_path / answer_name(url + tail)).write_text(body)
    lines = lambda *argv: list(run(parser().parse_args(argv), a))
    assert lines("stats", "ex.com") == ['{"pages":3}']
    assert len(lines("--live", "search", "ex.com")) == 3
    with pytest.raises(IndexTooLargeError):
        lines("--budget-pages", "2", "search", "ex.com")
    with pytest.raises(Exception, match="has 3 index pages"):
        read_pages(spark, query, a._servers(query), max_pages=2, answers=str(tmp_path)).collect()


def test_fetch_reads_a_shared_payload_once(spark, tmp_path):
    asked = tmp_path / "asked"
    captures = archive_with_payloads(spark).captures.withColumns({"length": F.lit(4).cast("long"), "filename": F.concat(F.lit("f"), "digest")})
    web = CountingTransport(str(asked))
    a = Archive(spark, captures, derived.crawls(spark), settings=Settings("https://data.example.com", web, str(tmp_path / "cache"), workers=2))
    got = a.fetch(captures).select("digest", "error").collect()
    assert len(got) == 5 and all(r["error"] == "no WARC record" for r in got)
    assert sorted(asked.read_text().split()) == sorted(f"https://data.example.com/fg{i}" for i in (0, 1, 2, 9))
    assert a.fetch(captures).count() == 5 and len(asked.read_text().split()) == 4  # now cached
    with pytest.raises(ConfigError):
        Archive(spark, captures, derived.crawls(spark)).fetch(captures)


def test_transport_rates_are_shared():
    web = HttpTransport("me", Politeness(6.0, 4)).shared_by(3)
    assert (web.politeness.rps, web.politeness.concurrency) == (2.0, 1)
    assert pickle.loads(pickle.dumps(web)).politeness.rps == 2.0


def test_live_registry_is_cached(spark, tmp_path):
    said = [{"id": "CC-MAIN-2031-09", "name": "September", "cdx-api": "https://i/9", "from": None, "to": "2031-09-12T00:00:00"}, {"id": "CC-MAIN-2031-02"}]
    store = cache.CacheStore(spark, str(tmp_path / "c"))
    web = FixedTransport({REGISTRY_URL: json.dumps(said)})
    ids = lambda df: [(r["id"], r["cdx-api"], r["crawl_ord"]) for r in df.collect()]
    first = ids(live_registry(spark, web, store, ttl=50, now=1000))
    assert first == [("CC-MAIN-2031-09", "https://i/9", 0), ("CC-MAIN-2031-02", None, 1)]
    web.answers[REGISTRY_URL] = json.dumps(said[1:])
    assert ids(live_registry(spark, web, store, ttl=50, now=1050)) == first
    assert len(ids(live_registry(spark, web, store, ttl=50, now=1060))) == 1
    assert len(ids(live_registry(spark, web, None))) == 1
    web.answers[REGISTRY_URL] = json.dumps(said)
    assert len(ids(live_registry(spark, web, store, ttl=50, now=1061, refresh=True))) == 2
    for bad in ("{", "3", "[3]"):
        with pytest.raises(ParseError):
            live_registry(spark, FixedTransport({REGISTRY_URL: bad}))


class CountingTransport:
    """Writes down what it is asked for."""

    def __init__(self, path):
        self.path = path

    def get_range(self, url, start, length):
        with open(self.path, "a") as f:
            f.write(url + "\n")
        return b"junk"[:length]


def test_cache(spark):
    c = spark.createDataFrame([("payload", "a", b"xx", 100, 0), ("payload", "b", b"yyy", 100, 10), ("index", "a", b"z", 100, 0)], "domain string, key string, value binary, written long, ttl long")
    now = F.lit(111)
    assert [r["value"] for r in cache.get(c, "payload", spark.createDataFrame([("a",), ("b",)], "key string"), now).collect()] == [b"xx"]
    live, gone = cache.collect_garbage(c, now)
    assert live.count() == 2 and gone.first()["reclaimed"] == 3
    newer = spark.createDataFrame([("payload", "a", b"new", 200, 0)], c.schema)
    assert cache.put(c, newer).where("key = 'a' and domain = 'payload'").first()["value"] == b"new"
    assert {r["domain"]: r["entries"] for r in cache.stats(c).collect()} == {"payload": 2, "index": 1}
    assert cache.layered(newer, c).where("key = 'b'").first()["ttl"] == 0


def test_cache_store_reads_the_buckets_of_its_keys(spark, tmp_path):
    store = cache.CacheStore(spark, str(tmp_path / "c"))
    assert store.get("payload", spark.createDataFrame([("k1",)], "key string"), F.lit(0)).count() == 0 and store.table().count() == 0 and store.stats().count() == 0
    rows = spark.range(2000).select(F.lit("payload").alias("domain"), F.concat(F.lit("k"), "id").alias("key"), F.encode(F.repeat(F.lit("v"), 50), "UTF-8").alias("value"), F.lit(1).cast("long").alias("written"), F.lit(0).cast("long").alias("ttl"))
    store.put(rows)
    store.put(rows.where("key = 'k7'").withColumns({"value": F.encode(F.lit("later"), "UTF-8"), "written": F.lit(2).cast("long")}))
    keys = spark.createDataFrame([("k7",), ("k1999",), ("none",), (None,), ("k7",)], "key string")
    buckets = store.buckets_of(keys.where("key is not null"))
    got = store.get("payload", keys, F.lit(5))
    assert {r["key"]: bytes(r["value"]) for r in got.collect()} == {"k7": b"later", "k1999": b"v" * 50}
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    try:
        text = store.get("payload", keys, F.lit(5))._jdf.queryExecution().executedPlan().toString()
        light = store.lookup("payload", keys, F.lit(5))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    parts = text.split("PartitionFilters: ")[1].split("], PushedFilters")[0]
    assert all(f"{b}" in parts for b in buckets) and "bucket" in parts and "(domain" in parts
    # no exchange of values: one of the wanted places at most
    assert "Exchange hashpartitioning" not in text and "SortMergeJoin" not in text and "BroadcastHashJoin" in text
    assert "value" not in light
    folders = {p.parent.name for p in (tmp_path / "c").rglob("*.parquet")}
    assert len(folders) > 200 and all(f.startswith("bucket=") for f in folders)


def test_cache_store_removes_and_collects(spark, tmp_path):
    store, kind = cache.CacheStore(spark, str(tmp_path / "c")), cache.SCHEMA
    key = lambda *ks: spark.createDataFrame([(k,) for k in ks], "key string")
    store.put(spark.createDataFrame([("payload", f"k{i}", bytes(10), 1, 0) for i in range(50)] + [("index", "k1", b"abc", 1, 5), ("index", None, b"n", 1, 0)], kind))
    store.put(spark.createDataFrame([("payload", "k3", b"new", 2, 0)], kind))
    store.remove("payload", key("k4", "k5"), F.lit(3))
    store.put(spark.createDataFrame([("payload", "k5", b"back", 4, 0)], kind))
    want = {f"k{i}": bytes(10) for i in range(50) if i != 4} | {"k3": b"new", "k5": b"back"}
    held = lambda: {r["key"]: bytes(r["value"]) for r in store.table().where("domain = 'payload'").collect()}
    assert held() == want and store.get("index", key("k1"), F.lit(7)).count() == 0 and store.get("index", key("k1"), F.lit(6)).count() == 1
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "c").rglob("*.parquet")}
    said = store.collect_garbage(F.lit(100)).first()
    # old k3, old k4, old k5 and the expired index entry; one bucket each
    assert said["reclaimed"] == 33 and said["buckets"] <= 4
    left = [p for p in before if p.exists()]
    assert held() == want and len(left) >= len(before) - 12 and all(p.stat().st_mtime_ns == before[p] for p in left)
    assert store.get("index", key("k1"), F.lit(0)).count() == 0 and store.get("payload", key("k4", "k5"), F.lit(9)).count() == 1
    # the tombstone of k4 hides nothing now, and goes
    again = store.collect_garbage(F.lit(100)).first()
    assert again["reclaimed"] == 0 and again["buckets"] == 1 and held() == want
    assert store.collect_garbage(F.lit(100)).first()["buckets"] == 0
    assert {r["domain"]: (r["entries"], r["bytes"]) for r in store.stats().collect()} == {"payload": (49, 47 * 10 + 7), "index": (1, 1)}


def test_memory_tier_weighs_bytes(spark):
    rows = spark.createDataFrame([("payload", f"k{i}", bytes(10), i, 1) for i in range(30)] + [("payload", "k29", bytes(15), 99, 0)], cache.SCHEMA)
    tier = cache.MemoryTier.of(rows, 46)
    assert {r["key"] for r in tier.entries.collect()} == {"k29", "k28", "k27", "k26"} and tier.entries.storageLevel.useMemory
    assert tier.get("payload", spark.createDataFrame([("k29",), ("k1",)], "key string")).first()["written"] == 99
    tier.drop()


def test_payload_files_appear_whole_or_not_at_all(spark, tmp_path):
    rows = spark.createDataFrame([(f"n{i}", bytes([i]) * i) for i in range(40)] + [("none", None), (None, b"x")], "name string, body binary").repartition(4)
    out = tmp_path / "out"
    said = {r["name"]: (r["bytes"], r["error"]) for r in sinks.write_payload_files(rows, str(out)).collect()}
    assert said["n7"] == (7, None) and said["none"] == (None, "no payload") and said[None] == (None, "no name")
    assert {p.name: p.read_bytes() for p in out.iterdir()} == {f"n{i}": bytes([i]) * i for i in range(40)}
    # a task that fails half-way leaves nothing, nor do those that had finished
    bad = rows.where("body is not null and name is not null").coalesce(1).select("name", F.when(F.col("name") == "n33", F.raise_error(F.lit("lost"))).otherwise(F.col("body")).cast("binary").alias("body"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        with pytest.raises(Exception, match="lost"):
            bad.write.format("payload_files").mode("append").save(str(tmp_path / "bad"))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert list((tmp_path / "bad").glob("*")) == []


def test_sketches_unite(spark, tmp_path):
    rows = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, "CC-MAIN-2024-01").otherwise("CC-MAIN-2024-04").alias("crawl"), F.concat(F.lit("k"), F.col("id") % 20_000).alias("urlkey"), F.concat(F.lit("d"), "id").alias("digest"), F.lit(2).cast("long").alias("length"))
    a = Archive(spark, rows, derived.crawls(spark))
    a.write_sketches(str(tmp_path / "s"))
    exact = {r["crawl"]: r for r in rows.groupBy("crawl").agg(F.countDistinct("urlkey").alias("urls"), F.countDistinct("digest").alias("digests")).collect()}
    for r in a.sketched_stats(str(tmp_path / "s")).collect():
        assert abs(r["urls"] / exact[r["crawl"]]["urls"] - 1) < 0.05 and abs(r["digests"] / exact[r["crawl"]]["digests"] - 1) < 0.05
    whole = a.sketched_stats(str(tmp_path / "s"), united=True).first()
    assert abs(whole["urls"] / 20_000 - 1) < 0.05 and abs(whole["digests"] / 60_000 - 1) < 0.05 and (whole["captures"], whole["bytes"]) == (60_000, 120_000)
    assert a.sketched_stats(str(tmp_path / "s"), "latest").count() == 1


def streamed(spark, tmp_path, name, rows, step, schema):
    """Run a stream over one more file of rows; (all rows put out so far, the query)."""
    source, out, state = (str(tmp_path / f"{name}-{x}") for x in ("in", "out", "state"))
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    query = step(spark.readStream.schema(schema).parquet(source)).writeStream.trigger(availableNow=True).option("checkpointLocation", state).start(out, format="parquet")
    query.awaitTermination()
    return spark.read.parquet(out), query


def test_changes_of_late_rows(spark, tmp_path):
    schema = "urlkey string, timestamp timestamp, digest string, filename string, offset long"
    row = lambda hour, digest, n, key="k": (key, datetime(2024, 1, 1 + hour // 24, hour % 24), digest, "f", n)
    streams.keep_state_on_disk(spark)
    try:
        go = lambda rows: streamed(spark, tmp_path, "late", rows, lambda s: streams.stream_changes(s, "10 hours"), schema)
        go([row(5, "b", 2), row(8, "b", 3), row(0, "a", 0)])
        # an earlier row of the key comes later, and splits what would have been one run
        go([row(6, "a", 9), row(2, "a", 1), row(30, "z", 7, "other")])
        got, query = go([row(7, "x", 11), row(60, "z", 8, "other")])
        assert sorted((r["offset"], r["digest"]) for r in got.where("urlkey = 'k'").collect()) == [(0, "a"), (2, "b"), (3, "b"), (9, "a")]
        assert streams.dropped_rows(query) == 1
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_sessions_and_late_rows(spark, tmp_path):
    schema = "urlkey string, timestamp timestamp, length long"
    row = lambda minute, key="k": (key, datetime(2024, 1, 1, minute // 60, minute % 60), 10)
    go = lambda rows: streamed(spark, tmp_path, "visits", rows, lambda s: streams.sessions(s, "30 minutes", "1 hour"), schema)
    go([row(0), row(50)])
    go([row(25)])  # joins the two
    got, _ = go([row(300, "j")])
    assert [(r["n"], r["bytes"], (r["stop"] - r["start"]).seconds) for r in got.collect()] == [(3, 30, 80 * 60)]
    got, query = go([row(26), row(60, "late"), row(600, "j")])
    assert streams.dropped_rows(query) == 2 and {r["urlkey"] for r in got.collect()} == {"k", "j"}


def test_stream_budget_is_restart_safe(spark, tmp_path):
    schema = "crawl_ord int, urlkey string, timestamp timestamp, filename string, offset long, crawl string, length long"
    rows = lambda *sizes: [(0, f"k{i}", datetime(2024, 1, 1), "f", i, "c", n) for i, n in enumerate(sizes)]
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))

    def go(*sizes, limits=budget.Budget(bytes=100)):
        spark.createDataFrame(rows(*sizes), schema).write.mode("append").parquet(source)
        streams.write_within(spark.readStream.schema(schema).parquet(source), limits, out, state).awaitTermination()
        return sorted(r["length"] for r in spark.read.parquet(out).collect())

    assert go(30, 20) == [20, 30]
    assert go(45) == [20, 30, 45]
    # the last trigger again, as after a crash between its rows and its commit
    last = max((tmp_path / "state" / "commits").glob("[0-9]"))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    assert go(4, 9, 1) == [4, 20, 30, 45]  # 9 doesn't fit, and ends it
    assert go(1) == [4, 20, 30, 45]


def test_command_line_cache(spark, tmp_path):
    a = archive_with_payloads(spark)
    store = cache.CacheStore(spark, str(tmp_path / "c"))
    store.put(spark.createDataFrame([("payload", "a", b"xyz", 1, 1), ("payload", "b", b"xy", 1, 0)], cache.SCHEMA))
    lines = lambda *argv: list(run(parser().parse_args(argv), a))
    assert lines("cache", str(tmp_path / "c")) == ['{"domain":"payload","entries":2,"bytes":5}']
    assert lines("cache", str(tmp_path / "c"), "--gc") == ['{"reclaimed":3,"buckets":1}']
    assert lines("cache", str(tmp_path / "c")) == ['{"domain":"payload","entries":1,"bytes":2}']
