"""Byte-level BPE by tree concatenation, and decoding.

Long text between special tokens is cut into halves, again and again, down to leaves that are
encoded in parallel.  Neighbouring results are joined by encoding a window around the join again
and letting it grow until its ends agree with both sides exactly.  Two kinds of window prove the
result right:

* between anchors: a space before a printable ASCII character always starts a piece of this
  tokenizer, whatever stands around it, so both sides and the window are cut there alike;
* inside one run of letters: a token sequence of one piece is the encoding if every two
  neighbours are (each pair is the encoding of its own text), so sequences that share a token may
  be spliced at it.

Otherwise the window grows to the whole text, which is encoding it plainly.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from array import array

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import by_bytes, map_arrow, text_column

#: Texts of more bytes than this go through the tree.
LEAF_BYTES = 16_384
#: Bytes to either side of a join in the first window.
WINDOW_BYTES = 48
#: Threads that encode leaves.
THREADS = 2
#: Words whose ids a worker remembers.
CACHE_WORDS = 200_000

_NO_ANCHOR = re.compile(r" (?:\s|\Z)")
_ANCHOR = re.compile(r" (?=\S)")


def byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: visible ones themselves, the rest from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class TreeEncoder:
    """Ids as the tokenizers library gives them for a byte-level BPE file, as little-endian 32-bit numbers."""

    def __init__(self, path: str, leaf: int = LEAF_BYTES, window: int = WINDOW_BYTES) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        chars, special = byte_of_char(), {x["content"]: x["id"] for x in model["added_tokens"]}
        vocab = {bytes(chars[c] for c in t): i for t, i in model["model"]["vocab"].items() if t not in special}
        self.fast = tiktoken.Encoding("leaf", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocab, special_tokens={})
        self.special = special
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.bytes_of = [b""] * (max([*vocab.values(), *special.values()]) + 1)
        for t, i in [*vocab.items(), *((s.encode(), i) for s, i in special.items())]:
            self.bytes_of[i] = t
        self.size_of = np.array([len(t) for t in self.bytes_of], np.int64)
        self.leaf, self.window = leaf, window
        self.known: dict[str, bytes] = {}

    def plain(self, text: str) -> list[int]:
        """Encode without the tree.  Beyond Latin letters the library itself decides what a letter is."""
        if text.isascii() or max(text) < "ɐ":
            return self.fast.encode_ordinary(text)
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known = {w: self.known[w] for w in words if w in self.known}
        for w in new:
            self.known[w] = array("I", self.plain(" " + w)).tobytes()

    def short(self, texts: list[str]) -> list[bytes]:
        """Encode leaf-sized texts word by word: an anchor before each word but the first."""
        split = [_ANCHOR.split(t) if _NO_ANCHOR.search(t) else t.split(" ") for t in texts]
        self.learn(set().union(*(s[1:] for s in split)))
        return [array("I", self.plain(s[0])).tobytes() + b"".join(map(self.known.__getitem__, s[1:])) for s in split]

    def long(self, text: str) -> np.ndarray:
        """Encode by halves and joins."""
        data = text.encode("utf-8", "surrogatepass")
        cuts = [0, len(data)]
        while max(b - a for a, b in zip(cuts, cuts[1:])) > self.leaf:
            grown = [0]
            for a, b in zip(cuts, cuts[1:]):
                m = (a + b) // 2
                while a < m and data[m] & 0xC0 == 0x80:
                    m -= 1
                grown += [m, b] if a < m and b - a > self.leaf else [b]
            if len(grown) == len(cuts):
                break
            cuts = grown
        parts = [data[a:b].decode() for a, b in zip(cuts, cuts[1:])]
        if text.isascii() or max(text) < "ɐ":
            ids = self.fast.encode_ordinary_batch(parts, num_threads=THREADS)
        else:
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]
        nodes = [(a, b, np.array(x, np.int64)) for a, b, x in zip(cuts[:-1], cuts[1:], ids, strict=True)]
        while len(nodes) > 1:
            joined = [(x[0], y[1], self.join(x[2], y[2], data, x[0], x[1], y[1])) for x, y in zip(nodes[::2], nodes[1::2])]
            nodes = joined + nodes[len(joined) * 2 :]
        return nodes[0][2]

    def join(self, left: np.ndarray, right: np.ndarray, data: bytes, a: int, c: int, b: int) -> np.ndarray:
        """Ids of data[a:b] from those of data[a:c] and data[c:b]."""
        if a == c or c == b:
            return np.concatenate([left, right])
        w = self.window
        while True:
            n = min(len(left), w + 1)  # a token has a byte at least
            starts = c - np.cumsum(self.size_of[left[len(left) - n :][::-1]])
            starts = starts[starts >= max(a, c - w)]
            ends = c + np.cumsum(self.size_of[right[: w + 1]])
            ends = ends[ends <= min(b, c + w)]
            i = next((k for k in range(len(starts) - 1, -1, -1) if starts[k] == a or self.anchor(data, int(starts[k]), c)), None)
            j = next((k for k in range(len(ends) - 1, -1, -1) if ends[k] == b or self.anchor(data, int(ends[k]), b)), None)
            if i is not None and j is not None:
                p, q = int(starts[i]), int(ends[j])
                mid = np.array(self.plain(data[p:q].decode()), np.int64)
                if (p == a or mid[0] == left[len(left) - 1 - i]) and (q == b or mid[-1] == right[j]):
                    return np.concatenate([left[: len(left) - 1 - i], mid, right[j + 1 :]])
            elif len(starts) and len(ends) and (spliced := self.splice(left, right, data, starts, ends, c)) is not None:
                return spliced
            if w >= b - a:
                return np.array(self.plain(data[a:b].decode()), np.int64)
            w *= 2

    @staticmethod
    def anchor(data: bytes, at: int, end: int) -> bool:
        return at + 1 < end and data[at] == 32 and 32 < data[at + 1] < 127

    def splice(self, left: np.ndarray, right: np.ndarray, data: bytes, starts: np.ndarray, ends: np.ndarray, c: int) -> np.ndarray | None:
        """Join inside one run of letters by a token that window and side share; None if there is no such window."""
        p, q = int(starts[-1]), int(ends[-1])
        try:
            text = data[p:q].decode()
        except UnicodeDecodeError:
            return None
        if not text.isalpha():
            return None
        mid = np.array(self.plain(text), np.int64)
        at = p + np.concatenate([[0], np.cumsum(self.size_of[mid])])
        where = {(int(s), int(t)): k for k, (s, t) in enumerate(zip(at[:-1], mid, strict=True))}
        lo = next((k for k, s in enumerate(starts.tolist()) if (s, int(left[len(left) - 1 - k])) in where), None)
        begins = (ends - self.size_of[right[: len(ends)]]).tolist()
        hi = next((k for k, s in enumerate(begins) if (s, int(right[k])) in where), None)
        if lo is None or hi is None:
            return None
        x, y = where[int(starts[lo]), int(left[len(left) - 1 - lo])], where[begins[hi], int(right[hi])]
        return np.concatenate([left[: len(left) - lo], mid[x + 1 : y], right[hi:]]) if x < y else None

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts; strings of special tokens get their ids, as the library does by default."""
        sections: list[tuple[int, str]] = []
        for k, t in enumerate(texts):
            sections += [(k, s) for s in (self.cut.split(t) if self.cut and "<|" in t else [t])]
        small = [(n, s) for n, (_, s) in enumerate(sections) if s not in self.special and len(s) <= self.leaf and len(s.encode("utf-8", "surrogatepass")) <= self.leaf]
        done = dict(zip((n for n, _ in small), self.short([s for _, s in small]), strict=True))
        out: list[list[bytes]] = [[] for _ in texts]
        for n, (k, s) in enumerate(sections):
            if s in self.special:
                out[k].append(np.array([self.special[s]], "<u4").tobytes())
            else:
                out[k].append(done[n] if n in done else self.long(s).astype("<u4").tobytes())
        return [b"".join(x) for x in out]

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the decoded text; bytes that are no UTF-8 become U+FFFD, special tokens stay."""
        raw = b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return raw.decode("utf-8", "replace").encode()


@functools.lru_cache(maxsize=1)
def encoder_of(path: str) -> TreeEncoder:
    """One encoder a worker process, so that its tasks share what it remembers."""
    return TreeEncoder(path)


def bpe_digests(docs: DataFrame, path: str | None = None, keep: tuple[str, ...] = (), with_ids: bool = False) -> DataFrame:
    """Encode and decode every text: doc_id, n_tokens, ids_sha256, decoded_sha256[, ids][, kept columns].

    Null texts count as empty (no ids); rows are independent, so repeated rows give repeated
    results and extra columns are ignored unless kept.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.json")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder = encoder_of(path)
        texts = batch.column(1).to_pylist()
        count, first, second, ids = [], [], [], []
        for a, b in by_bytes(texts, 1 << 21):
            for x in encoder.encode(texts[a:b]):
                count.append(len(x) // 4)
                first.append(hashlib.sha256(x).hexdigest())
                second.append(hashlib.sha256(encoder.decode(x)).hexdigest())
                if with_ids:
                    ids.append(np.frombuffer(x, "<i4").tolist())
        cols = {"doc_id": batch.column(0), "n_tokens": pa.array(count, pa.int64()), "ids_sha256": pa.array(first), "decoded_sha256": pa.array(second)}
        if with_ids:
            cols["ids"] = pa.array(ids, pa.list_(pa.int32()))
        return pa.RecordBatch.from_pydict(cols | {c: batch.column(2 + i) for i, c in enumerate(keep)})

    types = dict(docs.dtypes)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids + "".join(f", `{c}` {types[c]}" for c in keep)
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text"), *keep)
    return map_arrow(chosen, run, schema)
