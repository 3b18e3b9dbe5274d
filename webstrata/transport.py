"""Fetching from index servers: a transport with retries and politeness, and one over fixed answers."""

from __future__ import annotations

import hashlib
import json
import threading
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from typing import Any, Protocol
from urllib.parse import urlsplit

from pyarrow import fs

from .errors import ConfigError, HttpError, NetworkError, NotFoundError, RateLimitedError

MAX_RPS, MAX_CONCURRENCY, MAX_RETRIES, BASE_MS, CAP_MS = 2.0, 4, 5, 500, 30_000


def backoff_ms(attempt: int, base: int = BASE_MS, cap: int = CAP_MS) -> int:
    return min(base * 2**attempt, cap)


def user_agent(text: str) -> str:
    if not text.strip() or text.strip().lower() == "user-agent":
        raise ConfigError("a user agent that names you is needed")
    return text.strip()


class Politeness:
    """A token bucket for each class of host, and a cap on requests under way."""

    def __init__(self, rps: float = MAX_RPS, concurrency: int = MAX_CONCURRENCY, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.rps, self.concurrency, self.clock, self.sleep = rps, concurrency, clock, sleep
        self.slots, self.lock, self.next = threading.Semaphore(concurrency), threading.Lock(), dict[str, float]()

    def __reduce__(self) -> tuple:
        """Locks stay behind: each process paces its own requests."""
        return Politeness, (self.rps, self.concurrency, self.clock, self.sleep)

    @staticmethod
    def host_class(url: str) -> str:
        host = urlsplit(url).hostname or ""
        return host.partition(".")[0] if host.startswith(("index.", "data.")) else "other"

    def admit(self, url: str) -> None:
        with self.lock:
            kind, now = self.host_class(url), self.clock()
            at = max(now, self.next.get(kind, now))
            self.next[kind] = at + 1 / self.rps
        if at > now:
            self.sleep(at - now)


class Transport(Protocol):
    def get_text(self, url: str) -> str: ...

    def get_range(self, url: str, start: int, length: int) -> bytes: ...


class HttpTransport:
    """Live requests; 404 is NotFoundError, 429, 5xx and network failures are tried again (``Retry-After`` is honoured)."""

    def __init__(self, agent: str, politeness: Politeness | None = None, retries: int = MAX_RETRIES, opener: Callable[..., Any] = urllib.request.urlopen) -> None:
        self.agent, self.politeness, self.retries, self.open = user_agent(agent), politeness or Politeness(), retries, opener

    def fetch(self, url: str, headers: dict[str, str]) -> bytes:
        attempt = 0
        while True:
            self.politeness.admit(url)
            wait = backoff_ms(attempt) / 1000
            try:
                with self.politeness.slots, self.open(urllib.request.Request(url, headers={"User-Agent": self.agent, **headers}), timeout=60) as r:
                    return r.read()
            except urllib.error.HTTPError as e:
                if e.code == 404:
                    raise NotFoundError(url) from e
                if e.code != 429 and e.code < 500:
                    raise HttpError(e.code, url) from e
                if attempt >= self.retries:
                    raise (RateLimitedError(url) if e.code == 429 else HttpError(e.code, url)) from e
                said = e.headers.get("Retry-After") if e.headers else None
                wait = float(said) if said and said.isdigit() else wait
            except OSError as e:
                if attempt >= self.retries:
                    raise NetworkError(f"{url}: {e}") from e
            self.politeness.sleep(wait)
            attempt += 1

    def shared_by(self, workers: int) -> HttpTransport:
        """The same with this process's share of the rate; processes can't see each other's requests."""
        p = self.politeness
        return HttpTransport(self.agent, Politeness(p.rps / workers, max(1, p.concurrency // workers), p.clock, p.sleep), self.retries, self.open)

    def get_text(self, url: str) -> str:
        return self.fetch(url, {}).decode("utf-8", "replace")

    def get_range(self, url: str, start: int, length: int) -> bytes:
        return self.fetch(url, {"Range": f"bytes={start}-{start + length - 1}"})


class FixedTransport:
    """Answers by exact URL."""

    def __init__(self, answers: dict[str, str | bytes]) -> None:
        self.answers = answers

    def _get(self, url: str) -> bytes:
        if url not in self.answers:
            raise NotFoundError(url)
        a = self.answers[url]
        return a.encode() if isinstance(a, str) else a

    def get_text(self, url: str) -> str:
        return self._get(url).decode("utf-8", "replace")

    def get_range(self, url: str, start: int, length: int) -> bytes:
        return self._get(url)[start : start + length]


class FolderTransport:
    """Answers from files of a folder that every process can read, one a URL, as ``answer_name`` names them."""

    def __init__(self, root: str) -> None:
        self.root = root

    def _get(self, url: str) -> bytes:
        store, base = fs.FileSystem.from_uri(self.root) if "://" in self.root else (fs.LocalFileSystem(), self.root)
        try:
            with store.open_input_stream(f"{base.rstrip('/')}/{answer_name(url)}", compression=None) as f:
                return f.read()
        except FileNotFoundError as e:
            raise NotFoundError(url) from e

    def get_text(self, url: str) -> str:
        return self._get(url).decode("utf-8", "replace")

    def get_range(self, url: str, start: int, length: int) -> bytes:
        return self._get(url)[start : start + length]


def answer_name(url: str) -> str:
    return hashlib.sha1(url.encode()).hexdigest()


def pages_of(body: str) -> int:
    """Bare integer, or JSON with ``pages``; else 0."""
    try:
        said = json.loads(body)
    except ValueError:
        return 0
    said = said.get("pages") if isinstance(said, dict) else said
    return said if isinstance(said, int) and not isinstance(said, bool) and said >= 0 else 0


def num_pages(transport: Transport, url: str) -> int:
    try:
        return pages_of(transport.get_text(url))
    except NotFoundError:
        return 0


def lines_of(transport: Transport, url: str) -> list[str]:
    """Lines of one page; blank ones are skipped, an absent page has none."""
    try:
        return [x for x in transport.get_text(url).splitlines() if x.strip()]
    except NotFoundError:
        return []
