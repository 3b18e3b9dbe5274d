"""Errors of the engine; an empty result is no error."""

from __future__ import annotations


class ArchiveError(Exception):
    """Base of all errors; ``exit_code`` is the command line's."""

    exit_code = 1


class ConfigError(ArchiveError):
    exit_code = 2


class ParseError(ArchiveError):
    pass


class NotFoundError(ArchiveError):
    pass


class HttpError(ArchiveError):
    def __init__(self, status: int, url: str) -> None:
        super().__init__(f"HTTP {status} for {url}")
        self.status, self.url = status, url


class NetworkError(ArchiveError):
    pass


class StorageError(ArchiveError):
    pass


class RateLimitedError(ArchiveError):
    exit_code = 3


class BudgetExhaustedError(ArchiveError):
    """A run limit was met; ``resume`` is the key of the last row given, None before the first."""

    exit_code = 3

    def __init__(self, what: str, resume: str | None) -> None:
        super().__init__(f"{what} budget exhausted" + (f", resume after {resume}" if resume else ""))
        self.what, self.resume = what, resume


class IndexTooLargeError(ArchiveError):
    exit_code = 4

    def __init__(self, crawl: str, pages: int, most: int) -> None:
        super().__init__(f"{crawl} has {pages} index pages, the limit is {most}")
        self.crawl, self.pages, self.most = crawl, pages, most
