"""Main text of web pages by the maximum-scoring contiguous run of tokens.

A page is a sequence of words and tags.  Words score positive and tags negative, by weights learnt
from labelled pages; one linear scan finds the run with the largest sum, the main content.  Inside
it, elements that never hold article text are left out, by their kind or by what the same labels say
of their class words, and blocks are joined by one space.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterable
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

#: Labelled pages learnt from at most: those with the smallest hash of their text.
SAMPLE_PAGES = 1_000
#: Least weight of a word, greatest weight of a tag, and the weight of a tag never seen.
WORD, TAG, UNSEEN = 0.05, -0.1, -2.0

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var"
    " area base button embed img input link meta select source track wbr math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover".split()
)
#: Elements whose content is no markup, up to their end tag.
RAW = frozenset("script style textarea title iframe noembed noframes".split())
SKIP = frozenset("nav header footer aside form button select dialog menu noscript template svg".split())
#: Left out only where they don't hold the article or all paragraphs of the run, as whole pages may be wrapped in them.
WRAPS = SKIP - {"nav", "footer", "aside"}
#: Elements that hide those around them from the end tags inside.
SCOPE = frozenset("applet caption html table td th marquee".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Block elements whose start tag ends an open paragraph.
BLOCK = HEADINGS | frozenset(
    "address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form header hgroup hr li listing main menu nav ol p"
    " plaintext pre search section summary table ul xmp".split()
)
CELLS = frozenset("td th".split())
ROWS = CELLS | frozenset("tr caption colgroup".split())
GROUPS = frozenset("tbody thead tfoot".split())
#: Elements whose end tag may be left out: start tag -> (elements that it ends, elements that hide them).
IMPLIED = {
    "li": (("li",), SCOPE | BLOCK - {"address", "div", "p", "li"}),
    **dict.fromkeys(("dt", "dd"), (("dt", "dd"), SCOPE | BLOCK - {"address", "div", "p", "dt", "dd"})),
    "option": (("option",), frozenset(("select", "datalist", "optgroup"))),
    "optgroup": (("option", "optgroup"), frozenset(("select", "datalist"))),
    **dict.fromkeys(CELLS, (tuple(CELLS), frozenset(("table", "tr")))),
    "tr": (tuple(ROWS), frozenset(("table",))),
    **dict.fromkeys(GROUPS | {"caption", "colgroup"}, (tuple(ROWS | GROUPS), frozenset(("table",)))),
    "button": (("button",), SCOPE),
    "a": (("a",), SCOPE),
    **dict.fromkeys(("rt", "rp"), (("rt", "rp"), SCOPE | {"ruby"})),
}
#: End tag -> elements that hide the one it ends.
HIDES = {"p": SCOPE | {"button"}, "li": SCOPE | {"ul", "ol"}, "table": frozenset(("html",)), **dict.fromkeys(ROWS | GROUPS, frozenset(("table",)))}
#: Class words and roles of adverts, notices, menus and reader comments: taken as seen outside the article on so many pages.
OUTSIDE = frozenset(
    "ad ads advert adverts advertisement banner sponsored promo cookie-notice cookie-banner notice comments comment-list disqus share sharing sidebar breadcrumb breadcrumbs menu nav navbar navigation"
    " footer newsletter pagination complementary contentinfo search dialog alertdialog".split()
)
PRIOR_PAGES = 20
#: Pages that a class word was seen on at least before it counts, and the weight below which an element is left out.
LEAST_PAGES, CLASS_OUT = 10, -2.0
PAGE = frozenset("html body main article".split())
KNOWN = VOID | INLINE | RAW | SKIP | SCOPE | BLOCK | ROWS | GROUPS | PAGE | frozenset("head title option optgroup datalist legend label picture video audio".split())

_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_GAP = re.compile(r"[\s/]*")
_ATTRIBUTE = re.compile(r"=?[^\s/>=]*")
_EQUALS = re.compile(r"\s*=\s*")
_BARE = re.compile(r"[^\s>]*")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I | re.A) for name in RAW}


def class_weight(inside: int, outside: int, word: str) -> float:
    """Log-odds of a class word inside against outside of articles, in pages."""
    return math.log((inside + 0.5) / (outside + 0.5 + PRIOR_PAGES * (word in OUTSIDE)))


def class_score(words: Iterable[str], weights: dict[str, float]) -> float:
    """Sum of the weights of an element's class words; words that no label speaks of weigh nothing."""
    return sum(weights.get("c:" + w, class_weight(0, 0, w)) for w in set(words))


class Finder:
    """Places in a text that is read forward; no stretch is searched twice for one thing."""

    def __init__(self, text: str) -> None:
        self.text, self.seen = text, dict[object, tuple[int, int]]()

    def __call__(self, what: str | re.Pattern[str], at: int) -> int:
        """Where ``what`` comes next from ``at`` on; the text's length if nowhere."""
        asked, found = self.seen.get(what, (-1, -1))
        if asked < 0 or found < at:
            if isinstance(what, str):
                found = self.text.find(what, at)
            else:
                found = m.start() if (m := what.search(self.text, at)) else -1
            found = len(self.text) if found < 0 else found
            self.seen[what] = at, found
        return found


def tag_end(page: str, at: int, find: Finder) -> tuple[int, list[str]]:
    """(place behind the tag's ``>``, words of its class and role), from behind the tag's name; quotes count only around values.

    A quoted value that never ends is taken for a bare one.
    """
    hints: list[str] = []
    while True:
        at = _GAP.match(page, at).end()
        if at >= len(page) or page[at] == ">":
            return min(at + 1, len(page)), hints
        m = _ATTRIBUTE.match(page, at)
        name, at = m.group().lower(), m.end()
        if eq := _EQUALS.match(page, at):
            at = eq.end()
            quote = page[at : at + 1]
            close = find(quote, at + 1) if quote and quote in "\"'" else len(page)
            if close < len(page):
                value, at = page[at + 1 : close], close + 1
            else:
                m = _BARE.match(page, at)
                value, at = m.group(), m.end()
            if name in ("class", "role"):
                hints += value.lower().split()


class Token(NamedTuple):
    key: str  # what the weight hangs on: the tag, or the element around the words
    words: int  # 0 for a tag
    text: str
    tag: str  # name, with a slash before closing ones
    odd: bool  # a start tag whose class words say that its element is no article text


def tokens(page: str, weights: dict[str, float] | None = None, seen: dict[int, list[str]] | None = None) -> list[Token]:
    """Tags and runs of text in page order, in one pass; raw elements and comments are one tag each.

    As HTML has it, ``<`` is text unless a letter, ``/``, ``!`` or ``?`` follows; a comment that doesn't
    end, and a script or style that doesn't, run to the end of the page.  A tag without ``>`` is text.
    weights: of class words.  seen: gets the class words of each start tag, by token.
    """
    weights = weights or {}
    out: list[Token] = []
    around, at, n, find = "body", 0, len(page), Finder(page)
    text_from = 0

    def text_to(end: int) -> None:
        if end > text_from:
            t = page[text_from:end]
            out.append(Token("w:" + around, len(t.split()), t, "", False))

    while (at := find("<", at)) < n:
        after = page[at + 1 : at + 2]
        if after in ("!", "?") or (after == "/" and not page[at + 2 : at + 3].isalpha()):
            end = find("-->", at + 2) + 3 if page.startswith("<!--", at) else find(">", at) + 1
            if page.startswith("<!--", at) or end <= n:
                text_to(at)
                out.append(Token("comment", 0, "", "", False))
                at = text_from = min(end, n)
                continue
        elif (name := _NAME.match(page, at)) and find(">", at) < n:
            tag, close = name.group(1).lower(), after == "/"
            text_to(at)
            at, hints = tag_end(page, name.end(), find)
            if tag in RAW and not close and ((end := find(_RAW_END[tag], at)) < n or tag in ("script", "style")):
                out.append(Token(tag, 0, "", "", False))
                at = text_from = min(find(">", end) + 1, n)
                continue
            marked = not close and tag not in INLINE and tag not in PAGE and bool(hints)
            odd = marked and class_score(hints, weights) < CLASS_OUT
            if marked and seen is not None:
                seen[len(out)] = hints
            key = tag if tag in KNOWN else "other"
            out.append(Token(("/" if close else "") + key + ("!" if odd else ""), 0, "", ("/" if close else "") + tag, odd))
            if tag not in VOID and (tag not in INLINE or tag == "a"):
                around = "body" if close else key + ("!" if odd else "")
            text_from = at
            continue
        at += 1
    text_to(n)
    return out


def article(found: list[Token]) -> tuple[int, int] | None:
    """Start and end tag of the one article (or else main) element that a labelled page has; None for other pages."""
    for name in ("article", "main"):
        a = [i for i, t in enumerate(found) if t.tag == name]
        b = [i for i, t in enumerate(found) if t.tag == "/" + name]
        if len(a) == 1 and len(b) == 1 and a[0] < b[0]:
            return a[0], b[0]
    return None


def learn(pages: DataFrame, sample: int = SAMPLE_PAGES) -> dict[str, float]:
    """Log-odds weight of each token kind and, as ``c:word``, of class words, from at most ``sample`` pages whose markup labels their article.

    A class word counts once a page, outside only on elements that don't hold the article; words on
    fewer than ``LEAST_PAGES`` pages have no weight of their own.  Pages of one hash count together.
    """
    labelled = pages.where(F.col("html").rlike("(?i)<(article|main)[ >]"))
    chosen = labelled.select(F.xxhash64("html").alias("pick")).distinct().orderBy("pick").limit(sample)
    picked = labelled.select("html", F.xxhash64("html").alias("h")).join(F.broadcast(chosen), F.col("h") == F.col("pick"), "left_semi").select("html")

    def classes(batch: pa.RecordBatch) -> pa.RecordBatch:
        count: Counter[tuple[str, bool]] = Counter()
        for page in batch.column(0).to_pylist():
            seen: dict[int, list[str]] = {}
            found = tokens(page, seen=seen)
            if seen and (at := article(found)):
                ends = element_ends(found)
                count.update({(w, at[0] < i < at[1]) for i, words in seen.items() if not (i < at[0] and ends.get(i, 0) >= at[1]) for w in words})
        rows = list(count.items())
        return pa.RecordBatch.from_arrays([pa.array([w for (w, _), _ in rows], pa.string()), pa.array([i for (_, i), _ in rows], pa.bool_()), pa.array([n for _, n in rows], pa.int64())], names=["word", "inside", "n"])

    n = lambda inside: F.coalesce(F.sum(F.when(F.col("inside") == inside, F.col("n"))), F.lit(0))
    # of the sample's words those on LEAST_PAGES pages
    words = map_arrow(picked, classes, "word string, inside boolean, n long").groupBy("word").agg(n(True).alias("a"), n(False).alias("b")).where(F.col("a") + F.col("b") >= LEAST_PAGES).collect()
    known = {"c:" + r["word"]: class_weight(r["a"], r["b"], r["word"]) for r in words}

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        seen: Counter[tuple[str, bool]] = Counter()
        for page in batch.column(0).to_pylist():
            found = tokens(page, known)
            if at := article(found):
                for i, t in enumerate(found):
                    seen[t.key, at[0] < i < at[1]] += t.words or 1
        rows = list(seen.items())
        return pa.RecordBatch.from_arrays([pa.array([k for (k, _), _ in rows], pa.string()), pa.array([i for (_, i), _ in rows], pa.bool_()), pa.array([n for _, n in rows], pa.int64())], names=["key", "inside", "n"])

    # token kinds are HTML's element names and "other": some 400 rows at most
    rows = map_arrow(picked, count, "key string, inside boolean, n long").groupBy("key").agg(F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("inside"), 0).otherwise(F.col("n"))).alias("b")).collect()
    total = [sum(r[k] for r in rows) + 1 for k in ("a", "b")]
    odds = {r["key"]: math.log((r["a"] + 0.5) / total[0]) - math.log((r["b"] + 0.5) / total[1]) for r in rows}
    return {k: max(WORD, v) if k.startswith("w:") else min(TAG, v) for k, v in odds.items()} | known


#: Used where no page is labelled: words of running text count, links and menus hardly.
DEFAULT = {"w:p": 3.0, "w:h1": 2.0, "w:h2": 2.0, "w:blockquote": 2.0, "w:a": WORD, "w:li": 0.3, "w:body": 0.5, "p": -0.5, "/p": -0.5, "br": -0.2, "b": -0.2, "/b": -0.2}


def best_run(found: list[Token], weights: dict[str, float]) -> tuple[int, int]:
    """The run of tokens with the largest score (the earliest of equals), empty if none is positive."""
    best, begin, end = 0.0, 0, 0
    total, start = 0.0, 0
    for i, t in enumerate(found):
        w = weights.get(t.key)
        if t.words:
            total += t.words * (max(WORD, w) if w is not None else 1.0)
        elif not t.text:
            total += w if w is not None else UNSEEN
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, begin, end = total, start, i + 1
    return begin, end


class Open:
    """Open elements by HTML's rules for start and end tags that authors leave out; ``ends`` has where each start tag's element ended."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int]] = []  # (name, token); no name once it was closed out of turn
        self.at: dict[str, list[int]] = {}
        self.ends: dict[int, int] = {}
        self.now = 0

    def _wall(self, names: Iterable[str]) -> int:
        return max((self.at[n][-1] for n in names if self.at.get(n)), default=-1)

    def _cut(self, i: int) -> None:
        """Close the element at i and those inside it."""
        while len(self.stack) > i:
            name, token = self.stack.pop()
            if name:
                self.at[name].pop()
                self.ends[token] = self.now

    def _close(self, name: str, wall: int) -> None:
        at = self.at.get(name)
        if not at or at[-1] <= wall:
            return
        if name not in INLINE and name != "form":
            self._cut(at[-1])
            return
        # text-level elements and forms end alone: blocks inside that are still open go on
        i = at.pop()
        self.ends[self.stack[i][1]] = self.now
        self.stack[i] = ("", -1)
        while self.stack and not self.stack[-1][0]:
            self.stack.pop()

    def start(self, name: str) -> None:
        self.implied(name)
        if name not in VOID:
            self.at.setdefault(name, []).append(len(self.stack))
            self.stack.append((name, self.now))

    def implied(self, name: str) -> None:
        """End what a start tag ends."""
        if name in BLOCK and self.at.get("p"):
            self._close("p", self._wall(HIDES["p"]))
        if name in HEADINGS and self.stack and self.stack[-1][0] in HEADINGS:
            self._cut(len(self.stack) - 1)
        names, hide = IMPLIED.get(name, ((), ()))
        if any(self.at.get(n) for n in names):
            wall = self._wall(hide - set(names))
            for n in names:
                while self.at.get(n) and self.at[n][-1] > wall:
                    self._close(n, wall)

    def end(self, name: str) -> None:
        names = HEADINGS if name in HEADINGS else (name,)
        last = max(names, key=lambda n: self._wall((n,)))
        if self.at.get(last):
            self._close(last, self._wall(HIDES.get(name, SCOPE) - {name}))


def element_ends(found: list[Token]) -> dict[int, int]:
    """Token at which the element of each start tag ends."""
    elements = Open()
    for i, t in enumerate(found):
        elements.now = i
        if t.tag.startswith("/"):
            elements.end(t.tag[1:])
        elif t.tag:
            elements.start(t.tag)
    elements.now = len(found)
    elements._cut(0)
    return elements.ends


def main_text(page: str, weights: dict[str, float]) -> str:
    """Text of the best run: references decoded, white space of a block made single spaces, blocks joined by one space.

    A second scan leaves out elements inside the run: menus, forms and the like by kind, others by the
    score of their class words.  Each ends where HTML ends it: at its end tag, at a start tag that
    implies it, or with the element around it.  A wrapper such as a form stays where it holds the
    article element or every paragraph of the run.
    """
    found = tokens(page, weights)
    a, b = best_run(found, weights)
    ends = element_ends(found)
    held = [i for i in range(a, b) if found[i].tag in ("article", "main")] or [i for i in range(a, b) if found[i].tag == "p"]
    out: list[str] = []
    skip = 0
    for i in range(a, b):
        t = found[i]
        name = t.tag.lstrip("/")
        if name and name not in INLINE:
            out.append(" ")
        if i < skip:
            continue
        if t.text:
            out.append(html.unescape(t.text))
        elif name and t.tag == name and i in ends and (t.odd or name in SKIP):
            if t.odd or name not in WRAPS or not held or held[0] < i or held[-1] >= ends[i]:
                skip = ends[i]
    return " ".join("".join(out).split())


def extract(pages: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """page_id, url, text, n_chars (code points) for every row; null or empty html gives an empty text."""
    weights = learn(pages) if weights is None else weights
    weights = weights or DEFAULT

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(h, weights) for h in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    chosen = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    return map_arrow(chosen, run, "page_id long, url string, text string, n_chars long")
