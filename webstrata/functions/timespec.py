"""Time expressions, resolved on the driver against one ``now`` so that plans are deterministic."""

from __future__ import annotations

import calendar
import re
from datetime import UTC, datetime, timedelta

from ..errors import ConfigError

_RELATIVE = re.compile(r"^-?\s*(\d+)\s*([a-z]+)\s*(?:ago)?$")
# Unit spellings.
_UNITS = {
    "hours": "h hr hrs hour hours",
    "days": "d day days",
    "weeks": "w wk wks week weeks",
    "months": "mo mon mos month months",
    "years": "y yr yrs year years",
}
_UNIT = {word: unit for unit, words in _UNITS.items() for word in words.split()}
_FORMATS = (
    (re.compile(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d$"), "%Y-%m-%dT%H:%M:%S"),
    (re.compile(r"\d{14}$"), "%Y%m%d%H%M%S"),
    (re.compile(r"\d{8}$"), "%Y%m%d"),
    (re.compile(r"\d{4}-\d\d-\d\d$"), "%Y-%m-%d"),
    (re.compile(r"\d{4}-\d\d$"), "%Y-%m"),
    (re.compile(r"\d{4}$"), "%Y"),
)


def months_before(when: datetime, months: int) -> datetime:
    total = when.year * 12 + when.month - 1 - months
    year, month = divmod(total, 12)
    return when.replace(year=year, month=month + 1, day=min(when.day, calendar.monthrange(year, month + 1)[1]))


def parse(text: str, now: datetime | None = None) -> datetime:
    """A UTC time: now/today/yesterday, ``3d``, ``6 months ago``, RFC 3339, or a date of any precision."""
    now = (now or datetime.now(UTC)).astimezone(UTC)
    word = text.strip()
    low = word.lower()
    midnight = now.replace(hour=0, minute=0, second=0, microsecond=0)
    if low in ("now", "today", "yesterday"):
        return {"now": now, "today": midnight, "yesterday": midnight - timedelta(days=1)}[low]
    if (m := _RELATIVE.match(low)) and (unit := _UNIT.get(m.group(2))):
        n = int(m.group(1))
        try:
            return months_before(now, n * (12 if unit == "years" else 1)) if unit in ("months", "years") else now - timedelta(**{unit: n})
        except (ValueError, OverflowError) as e:
            raise ConfigError(f"time out of range: {text!r}") from e
    if re.match(r"\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$", word):
        try:
            return datetime.fromisoformat(word.upper().replace("Z", "+00:00")).astimezone(UTC)
        except ValueError as e:
            raise ConfigError(f"no time: {text!r}") from e
    for shape, form in _FORMATS:
        if shape.match(word):
            try:
                return datetime.strptime(word, form).replace(tzinfo=UTC)
            except ValueError:
                continue
    raise ConfigError(f"no time: {text!r}")


def parse_range(start: str | None, end: str | None, now: datetime | None = None) -> tuple[datetime, datetime] | None:
    """Both ends inclusive; an open start is the epoch, an open end is now; None if both are open."""
    if start is None and end is None:
        return None
    now = now or datetime.now(UTC)
    return parse(start, now) if start else datetime(1970, 1, 1, tzinfo=UTC), parse(end, now) if end else now
