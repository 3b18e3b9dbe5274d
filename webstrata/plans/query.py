"""The declarative URL query."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from datetime import datetime
from enum import Enum

from .crawls import CrawlSelector


class MatchType(Enum):
    EXACT = "exact"
    PREFIX = "prefix"
    HOST = "host"
    DOMAIN = "domain"

    @classmethod
    def parse(cls, text: str) -> MatchType:
        """Unknown words mean prefix."""
        return next((m for m in cls if m.value == text.strip().lower()), cls.PREFIX)


@dataclass(frozen=True)
class Status:
    """``codes`` (any of them; none matches nothing) or a ``hundred`` (2 for 200..299)."""

    codes: tuple[int, ...] | None = None
    hundred: int | None = None


@dataclass(frozen=True)
class Mime:
    """Declared or detected type."""

    value: str


@dataclass(frozen=True)
class Language:
    value: str


@dataclass(frozen=True)
class Tld:
    value: str


@dataclass(frozen=True)
class UrlRegex:
    pattern: str


Filter = Status | Mime | Language | Tld | UrlRegex


@dataclass(frozen=True)
class Collapse:
    """One row for each value of ``by``: digest, urlkey, or timestamp (its first ``digits`` digits, per urlkey)."""

    by: str
    digits: int = 14
    adjacent: bool = False

    @property
    def token(self) -> str:
        return f"timestamp:{self.digits}" if self.by == "timestamp" else self.by

    @classmethod
    def parse(cls, text: str) -> Collapse:
        """Unknown words mean digest."""
        kind, _, digits = text.strip().partition(":")
        if kind == "timestamp":
            return cls("timestamp", int(digits) if digits.isdigit() else 14)
        return cls("urlkey" if kind == "urlkey" else "digest")


#: Index field of each projectable column.
FIELD_TOKENS = {
    "urlkey": "urlkey", "timestamp": "timestamp", "url": "url", "mime": "mime", "mime_detected": "mime-detected", "status": "status",
    "digest": "digest", "length": "length", "offset": "offset", "filename": "filename", "languages": "languages", "redirect": "redirect",
}


@dataclass(frozen=True)
class UrlQuery:
    pattern: str
    match: MatchType = MatchType.PREFIX
    crawls: CrawlSelector = field(default_factory=CrawlSelector)
    filters: tuple[Filter, ...] = ()
    collapse: Collapse | None = None
    fields: tuple[str, ...] | None = None
    time_range: tuple[datetime, datetime] | None = None
    limit: int | None = None

    @classmethod
    def exact(cls, pattern: str) -> UrlQuery:
        return cls(pattern, MatchType.EXACT)

    @classmethod
    def prefix(cls, pattern: str) -> UrlQuery:
        return cls(pattern, MatchType.PREFIX)

    @classmethod
    def host(cls, pattern: str) -> UrlQuery:
        return cls(pattern, MatchType.HOST)

    @classmethod
    def domain(cls, pattern: str) -> UrlQuery:
        return cls(pattern, MatchType.DOMAIN)

    def where(self, *filters: Filter) -> UrlQuery:
        return replace(self, filters=self.filters + filters)

    def status(self, *codes: int) -> UrlQuery:
        return self.where(Status(codes))

    def status_class(self, hundred: int) -> UrlQuery:
        return self.where(Status(hundred=hundred))

    def mime(self, value: str) -> UrlQuery:
        return self.where(Mime(value))

    def language(self, value: str) -> UrlQuery:
        return self.where(Language(value))

    def tld(self, value: str) -> UrlQuery:
        return self.where(Tld(value))

    def url_regex(self, pattern: str) -> UrlQuery:
        return self.where(UrlRegex(pattern))

    def collapsed(self, collapse: Collapse) -> UrlQuery:
        return replace(self, collapse=collapse)

    def select(self, *fields: str) -> UrlQuery:
        return replace(self, fields=fields)

    def in_crawls(self, selector: CrawlSelector | str) -> UrlQuery:
        return replace(self, crawls=CrawlSelector.parse(selector) if isinstance(selector, str) else selector)

    def between(self, start: datetime, end: datetime) -> UrlQuery:
        return replace(self, time_range=(start, end))

    def take(self, limit: int) -> UrlQuery:
        return replace(self, limit=limit)
