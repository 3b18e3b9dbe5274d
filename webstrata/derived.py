"""A capture index derived from the ``events`` and ``pages`` tables, for queries and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.urls import surt
from .schema import COLUMNS
from .sources.captures import registry

REGISTRY_ROWS = [
    ("CC-MAIN-2024-04", "2024-01-25T00:00:00", "2024-01-31T00:00:00"),
    ("CC-MAIN-2024-03", "2024-01-17T00:00:00", "2024-01-24T00:00:00"),
    ("CC-MAIN-2024-02", "2024-01-09T00:00:00", "2024-01-16T00:00:00"),
    ("CC-MAIN-2024-01", "2024-01-01T00:00:00", "2024-01-08T00:00:00"),
    ("CC-MAIN-2020-05", "2020-01-01T00:00:00", None),
]


def crawls(spark: SparkSession) -> DataFrame:
    return registry(spark, REGISTRY_ROWS)


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One capture an event: of the page that the event's id selects, in the crawl of its day."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.col("url").alias("p_url"))
    # what hangs on the address alone is derived once a page, not once an event
    pages = pages.withColumns({"p_key": surt(F.col("p_url")), "p_lang": F.regexp_extract("p_url", "^[a-z]+://[^/]+/([a-z]+)/", 1)})
    n = pages.count()
    day = F.dayofmonth("ts")
    crawl = F.when(day <= 8, "CC-MAIN-2024-01").when(day <= 16, "CC-MAIN-2024-02").when(day <= 24, "CC-MAIN-2024-03").otherwise("CC-MAIN-2024-04")
    pdf = F.col("user_id") % 5 == 0
    lang = F.col("p_lang")
    code = (
        F.when(F.col("event_type").isin("view", "click", "purchase"), 200).when(F.col("event_type") == "signup", 301)
        .when(F.col("event_id") % 3 == 0, 403).when(F.col("event_id") % 3 == 1, 404).otherwise(503)
    )
    rows = events.join(pages, F.col("page_id") == F.col("event_id") % n).select(
        crawl.alias("crawl"),
        F.when(day <= 8, 3).when(day <= 16, 2).when(day <= 24, 1).otherwise(0).alias("crawl_ord"),
        F.col("p_key").alias("urlkey"),
        F.col("p_url").alias("url"),
        F.col("ts").alias("timestamp"),
        code.alias("status"),
        F.when(F.col("user_id") % 7 != 0, F.when(pdf, "application/pdf").otherwise("text/html")).alias("mime"),
        F.when(pdf, "application/pdf").otherwise("text/html").alias("mime_detected"),
        F.when(lang == "en", F.array(F.lit("eng"))).when(lang == "fr", F.array(F.lit("fra"), F.lit("eng"))).when(lang == "de", F.array(F.lit("deu")))
        .when(lang == "es", F.array(F.lit("spa"))).otherwise(F.array().cast("array<string>")).alias("languages"),
        F.concat(F.lit("sha1:"), F.md5(F.concat("p_url", F.lit(":"), (F.col("user_id") % 3).cast("string")))).alias("digest"),
        (F.lit(100) + F.col("user_id")).alias("length"),
        (F.col("event_id") * 1000).alias("offset"),
        F.concat(F.lit("crawl-data/"), crawl, F.lit("/seg-"), (F.col("event_id") % 4).cast("string"), F.lit(".warc.gz")).alias("filename"),
        F.when(F.col("event_type") == "signup", F.concat("p_url", F.lit("?r=1"))).alias("redirect"),
        F.lit(None).cast("string").alias("truncated"),
    )
    return rows.select(*COLUMNS, "crawl_ord")


#: The same relation in SQL, to put before a SELECT.
CTE = """
with np as (select count(*) as n from pages),
b as (select e.event_id, e.ts, e.user_id, e.event_type, p.url, p.page_id
      from events e cross join np join pages p on p.page_id = e.event_id % np.n),
k as (select b.*, case when day(ts)<=8  then 'CC-MAIN-2024-01' when day(ts)<=16 then 'CC-MAIN-2024-02'
                       when day(ts)<=24 then 'CC-MAIN-2024-03' else 'CC-MAIN-2024-04' end as crawl from b),
captures as (select crawl,
  case crawl when 'CC-MAIN-2024-04' then 0 when 'CC-MAIN-2024-03' then 1 when 'CC-MAIN-2024-02' then 2 else 3 end as crawl_ord,
  concat(array_to_string(list_reverse(string_split(regexp_replace(lower(regexp_extract(url,'^[a-z]+://([^/:?#]+)',1)),'^www[.]',''),'.')),','), ')',
    lower(coalesce(nullif(regexp_extract(url,'^[a-z]+://[^/?#]+([^?#]*)',1),''),'/')), lower(regexp_extract(url,'^[^?#]*([?][^#]*)',1))) as urlkey,
  url, ts as timestamp,
  case when event_type in ('view','click','purchase') then 200 when event_type='signup' then 301
       when event_id%3=0 then 403 when event_id%3=1 then 404 else 503 end as status,
  case when user_id%7=0 then null when user_id%5=0 then 'application/pdf' else 'text/html' end as mime,
  case when user_id%5=0 then 'application/pdf' else 'text/html' end as mime_detected,
  case regexp_extract(url,'^[a-z]+://[^/]+/([a-z]+)/',1)
       when 'en' then 'eng' when 'fr' then 'fra,eng' when 'de' then 'deu' when 'es' then 'spa' else '' end as languages_csv,
  concat('sha1:', md5(concat(url, ':', cast(user_id%3 as varchar)))) as digest,
  100+user_id as length, event_id*1000 as "offset",
  concat('crawl-data/', crawl, '/seg-', cast(event_id%4 as varchar), '.warc.gz') as filename,
  case when event_type='signup' then concat(url,'?r=1') end as redirect,
  cast(null as varchar) as truncated
from k)
"""
