"""Crawl selection: text to selector to predicate on the registry."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigError
from ..functions import timespec


@dataclass(frozen=True)
class CrawlSelector:
    """One of: all (nothing set), the newest ``latest``, ``ids``, ``years`` inclusive, ``since``."""

    latest: int | None = None
    ids: tuple[str, ...] | None = None
    years: tuple[int, int] | None = None
    since: datetime | None = None

    @classmethod
    def parse(cls, text: str, now: datetime | None = None) -> CrawlSelector:
        word = text.strip()
        low = word.lower()
        if low == "all":
            return cls()
        if low == "latest":
            return cls(latest=1)
        if word.startswith("latest-"):
            if not word[7:].isdigit():
                raise ConfigError(f"no crawl count: {text!r}")
            return cls(latest=int(word[7:]))
        if word.startswith("since:"):
            return cls(since=timespec.parse(word[6:], now))
        if ".." in word:
            a, _, b = word.partition("..")
            if not (a.strip().isdigit() and b.strip().isdigit()):
                raise ConfigError(f"no year range: {text!r}")
            return cls(years=(int(a), int(b)))
        if "CC-MAIN" in word or "," in word:
            return cls(ids=tuple(x.strip() for x in word.split(",") if x.strip()))
        raise ConfigError(f"no crawl selector: {text!r}")

    def __str__(self) -> str:
        if self.latest is not None:
            return "latest" if self.latest == 1 else f"latest-{self.latest}"
        if self.ids is not None:
            return ",".join(self.ids)
        if self.years is not None:
            return f"{self.years[0]}..{self.years[1]}"
        return f"since:{self.since:%Y-%m-%d}" if self.since else "all"

    def predicate(self) -> Column:
        """Over registry rows with ``crawl_ord`` (0 is newest)."""
        year = crawl_year(F.col("id"))
        if self.latest is not None:
            return F.col("crawl_ord") < self.latest
        if self.ids is not None:
            return F.col("id").isin(*self.ids) if self.ids else F.lit(False)
        if self.years is not None:
            return F.coalesce(year.between(*self.years), F.lit(False))
        if self.since is not None:
            end = coverage_time(F.col("to"))
            return F.coalesce(end >= F.lit(self.since.replace(tzinfo=None)).cast("timestamp_ntz"), year >= self.since.year, F.lit(False))
        return F.lit(True)


def crawl_year(crawl: Column) -> Column:
    """The first four-digit part of an id; null without one."""
    return F.regexp_extract(crawl, r"(?:^|-)(\d{4})(?=-|$)", 1).try_cast("int")


def year_of(crawl: str) -> int | None:
    m = re.search(r"(?:^|-)(\d{4})(?=-|$)", crawl)
    return int(m.group(1)) if m else None


def coverage_time(text: Column) -> Column:
    """Registry dates: with or without a time and a zone; null if unreadable."""
    return F.regexp_replace(text, r"(?:Z|[+]00:?00)$", "").try_cast("timestamp_ntz")


def select_crawls(registry: DataFrame, selector: CrawlSelector) -> DataFrame:
    """Registry rows chosen, in registry order."""
    return registry.where(selector.predicate()).orderBy("crawl_ord")


def resolve(registry: DataFrame, selector: CrawlSelector) -> list[str]:
    """Ids chosen, newest first.  The registry has about one row a month, so they are collected."""
    return [r["id"] for r in select_crawls(registry, selector).select("id").collect()]
