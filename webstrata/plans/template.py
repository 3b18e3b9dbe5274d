"""URL templates: literals and ``{name}`` holes, compiled to one regular expression."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ConfigError
from ..functions.urls import stripped


def _escape(text: str) -> str:
    return re.sub(r"([^\w])", r"\\\1", text)


@dataclass(frozen=True)
class UrlTemplate:
    """parts: (literal, None) or (None, hole name)."""

    text: str
    parts: tuple[tuple[str | None, str | None], ...]

    @classmethod
    def parse(cls, text: str) -> UrlTemplate:
        """Raises ConfigError for a hole without end or name."""
        parts: list[tuple[str | None, str | None]] = []
        rest = text
        while rest:
            lit, brace, rest = rest.partition("{")
            if lit:
                parts.append((lit, None))
            if brace:
                name, end, rest = rest.partition("}")
                if not end or not name:
                    raise ConfigError(f"bad hole in template {text!r}")
                parts.append((None, name))
        return cls(text, tuple(parts))

    @property
    def prefix(self) -> str:
        """The leading literal, which bounds the scan."""
        return self.parts[0][0] or "" if self.parts and self.parts[0][0] else ""

    def regex(self) -> str:
        """A hole runs to the first place of the next literal, the last one to the end; text after a final literal is free; neighbouring holes match nothing."""
        out = "^"
        for i, (lit, _) in enumerate(self.parts):
            if lit is not None:
                out += _escape(lit)
            elif i + 1 == len(self.parts):
                out += r"([\s\S]+)$"
            elif (after := self.parts[i + 1][0]) is None:
                return r"^(?!)" + "()" * sum(1 for _, n in self.parts if n)
            else:
                out += rf"((?:(?!{_escape(after)})[\s\S])+)"
        return out

    def bind(self, url: Column) -> Column:
        """Map of hole values in name order; null where the template doesn't match.  Of equal names the last counts."""
        text, pattern = stripped(url), self.regex()
        groups = {name: i + 1 for i, name in enumerate(n for _, n in self.parts if n)}
        cells = [x for name in sorted(groups) for x in (F.lit(name), F.regexp_extract(text, pattern, groups[name]))]
        made = F.create_map(*cells) if cells else F.create_map().cast("map<string,string>")
        return F.when(text.rlike(pattern), made)
