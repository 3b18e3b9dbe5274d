"""Seed discovery: robots and sitemap bodies to URLs."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce as fold

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import decode_entities
from ..session import stored


def sitemap_lines(robots: Column) -> Column:
    """Targets of a robots file's sitemap lines, in order, empties dropped."""
    lines = F.filter(F.split(F.coalesce(robots, F.lit("")), r"\r?\n"), lambda x: x.rlike(r"(?i)^\s*sitemap:"))
    return F.filter(F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"(?i)^\s*sitemap:", ""))), lambda x: x != "")


def locations(xml: Column) -> Column:
    """Contents of every closed ``loc`` element, trimmed, references decoded, empties dropped."""
    found = F.regexp_extract_all(F.coalesce(xml, F.lit("")), F.lit(r"<loc>([\s\S]*?)</loc>"), F.lit(1))
    return F.filter(F.transform(found, lambda x: decode_entities(F.regexp_replace(x, r"^\s+|\s+$", ""))), lambda x: x != "")


def robots_sitemaps(bodies: DataFrame, body: str = "body") -> DataFrame:
    return bodies.select(*(c for c in bodies.columns if c != body), F.explode(sitemap_lines(F.col(body))).alias("sitemap"))


def sitemap_urls(bodies: DataFrame, body: str = "body") -> DataFrame:
    return bodies.select(*(c for c in bodies.columns if c != body), F.explode(locations(F.col(body))).alias("loc"))


def seeds(sitemaps: DataFrame, found: DataFrame) -> DataFrame:
    """Sitemap addresses and the URLs in them, each once, sorted."""
    return sitemaps.select(F.col("sitemap").alias("url")).union(found.select(F.col("loc").alias("url"))).distinct().orderBy("url")


def follow(roots: DataFrame, texts_of: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(``sitemap`` addresses, ``loc`` of the pages in them), from ``roots`` (sitemap) through sitemap indexes of any depth.

    texts_of: archived texts (url, text) of wanted addresses (url).  A round fetches the frontier:
    what indexes name and no round has seen.  It ends when nothing is new, so indexes that name
    each other end it too; rounds are as many as indexes are deep, each stored.
    """
    seen = frontier = stored(roots.select("sitemap").distinct(), "frontier")
    found: list[DataFrame] = []
    while not frontier.isEmpty():
        index = F.coalesce(F.col("text").rlike(r"(?i)<sitemapindex[\s>]"), F.lit(False))
        locs = stored(texts_of(frontier.select(F.col("sitemap").alias("url"))).select(index.alias("of_index"), F.explode(locations(F.col("text"))).alias("loc")), "locations")
        found.append(locs.where(~F.col("of_index")).select("loc"))
        frontier = stored(locs.where("of_index").select(F.col("loc").alias("sitemap")).distinct().join(seen, "sitemap", "left_anti"), "frontier")
        seen = stored(seen.union(frontier), "seen")
    return seen, fold(DataFrame.union, found) if found else seen.select(F.col("sitemap").alias("loc")).limit(0)
