"""Sentence-piece BPE by vectorised merge rounds, and decoding.

Texts are cut into words that no piece can cross: wherever two neighbouring characters stand in no
piece side by side.  The symbols of many words lie in one flat array.  A round finds the best pair
rank of each word, merges that pair's leftmost occurrences in all words at once, and closes the
gaps; words without a pair leave the array, until none remains.

Merging every occurrence at once is what merging one by one gives, unless the new symbol could make
a pair that ranks no worse: ranks of such pieces (known from the vocabulary) merge one occurrence a
round.  Words of very many symbols keep their positions by rank instead, so that a round costs
what it merges.
"""

from __future__ import annotations

import functools
import hashlib
import heapq

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from .common import by_bytes, map_arrow, text_column

#: Words whose ids a worker remembers, and characters of such a word at most.
CACHE_WORDS, CACHE_CHARS = 700_000, 64
#: Characters that are encoded at once.
SECTION = 1 << 21
#: Symbols from which on a word's rounds go by rank.
LONG = 2048
# The sign for a space, and kinds of pieces in a model file.
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6

_NONE = np.int64(1 << 40)
_CODES, _LOW = 0x110000, 0x400


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)


class PieceEncoder:
    """Ids as the sentencepiece library gives them for a BPE model with byte fallback and identity normalisation."""

    def __init__(self, path: str, long: int = LONG) -> None:
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, train, pieces = model.normalizer_spec, model.trainer_spec, model.pieces
        if train.model_type != 2 or not train.byte_fallback or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or not norm.add_dummy_prefix or train.treat_whitespace_as_suffix or {p.type for p in pieces} - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("only BPE models with byte fallback, a dummy prefix and identity normalisation")
        self.long, self.size, self.wide = long, len(pieces), len(pieces) + _CODES
        self.begin, self.end = train.bos_id, train.eos_id
        ids = {p.piece: i for i, p in enumerate(pieces) if p.type == NORMAL}
        order = {s: k for k, s in enumerate(sorted({p.score for p in pieces if p.type == NORMAL}, reverse=True))}
        rank = {w: order[pieces[i].score] for w, i in ids.items()}
        symbol = lambda w: ids.get(w, self.size + ord(w) if len(w) == 1 else None)

        pairs: dict[int, tuple[int, int]] = {}
        self.late = np.zeros(len(order), bool)
        beside = set()
        for w, i in ids.items():
            beside |= {ord(a) << 21 | ord(b) for a, b in zip(w, w[1:])}
            for k in range(1, len(w)):
                x, y = symbol(w[:k]), symbol(w[k:])
                if x is not None and y is not None:
                    pairs[x * self.wide + y] = rank[w], i
                    for part in (w[:k], w[k:]):
                        if len(part) > 1 and rank[w] <= rank[part]:
                            self.late[rank[part]] = True
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.found = np.array([pairs[k] for k in self.keys.tolist()], np.int64).reshape(-1, 2)
        self.beside = np.array(sorted(beside), np.int64)
        self.symbol_of = np.arange(_CODES, dtype=np.int64) + self.size
        for w, i in ids.items():
            if len(w) == 1:
                self.symbol_of[ord(w)] = i
        self.byte_ids = np.zeros(256, np.int64)
        self.bytes_of = []
        for i, p in enumerate(pieces):
            if p.type == BYTE:
                self.byte_ids[int(p.piece[3:-1], 16)] = i
            self.bytes_of.append({NORMAL: p.piece.replace(SPACE, " ").encode(), UNKNOWN: train.unk_surface.encode(), CONTROL: b"", BYTE: bytes([int(p.piece[3:-1], 16)]) if p.type == BYTE else b""}[p.type])
        self.kinds = [p.type for p in pieces]
        # of low characters, as a table
        self.low = np.zeros((_LOW, _LOW), bool)
        for a, b in ((k >> 21, k & 0x1FFFFF) for k in beside):
            if a < _LOW and b < _LOW:
                self.low[a, b] = True
        self.known: dict[str, bytes] = {}

    def look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged symbol) of pairs; those that aren't in the vocabulary have rank ``_NONE``."""
        key = left * self.wide + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.found[at, 0], _NONE), self.found[at, 1]

    def rounds(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, word of each) after all merges; ``word`` ascends."""
        at, done = np.arange(len(sym)), []
        rank = np.full(len(sym), _NONE)
        made = np.zeros(len(sym), np.int64)
        inside = np.flatnonzero(word[:-1] == word[1:])
        rank[inside], made[inside] = self.look(sym[inside], sym[inside + 1])
        while len(sym):
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            sizes = np.diff(np.concatenate([starts, [len(sym)]]))
            best = np.repeat(np.minimum.reduceat(rank, starts), sizes)
            over = best == _NONE
            if over.any():
                done.append((at[over], sym[over], word[over]))
                keep = ~over
                at, sym, word, rank, made, best = at[keep], sym[keep], word[keep], rank[keep], made[keep], best[keep]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == best)
            new_word = np.concatenate([[True], word[hit[1:]] != word[hit[:-1]]])
            run = np.concatenate([[True], hit[1:] != hit[:-1] + 1])
            nth = np.arange(len(hit))
            chosen = (nth - np.maximum.accumulate(np.where(run, nth, 0))) % 2 == 0
            hit = hit[np.where(self.late[best[hit]], new_word, chosen)]
            sym[hit] = made[hit]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            at, sym, word, rank, made = at[keep], sym[keep], word[keep], rank[keep], made[keep]
            now = hit - np.arange(len(hit))
            touched = np.zeros(len(sym), bool)
            touched[now] = touched[now[now > 0] - 1] = True
            near = np.flatnonzero(touched)
            inside = near[near < len(sym) - 1]
            inside = inside[word[inside] == word[inside + 1]]
            rank[near] = _NONE
            rank[inside], made[inside] = self.look(sym[inside], sym[inside + 1])
        if not done:
            return sym, word
        at, sym, word = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(at)
        return sym[order], word[order]

    def long_rounds(self, sym: np.ndarray) -> np.ndarray:
        """Symbols of one word after all merges: positions by rank, each round takes those of the best."""
        n = len(sym)
        sym, after, before, alive = sym.copy(), np.arange(1, n + 1), np.arange(-1, n - 1), np.ones(n, bool)
        rank, made = np.full(n, _NONE), np.zeros(n, np.int64)
        places: dict[int, list] = {}
        ranks: list[int] = []

        def add(at: np.ndarray) -> None:
            """File positions under their pairs' ranks."""
            right = after[at]
            at, right = at[right < n], right[right < n]
            rank[at], made[at] = self.look(sym[at], sym[right])
            at = at[rank[at] < _NONE]
            at = at[np.argsort(rank[at], kind="stable")]
            for part in np.split(at, np.flatnonzero(np.diff(rank[at])) + 1):
                if len(part):
                    put(int(rank[part[0]]), part)

        def put(r: int, part: np.ndarray) -> None:
            if r not in places:
                places[r] = []
                heapq.heappush(ranks, r)
            if self.late[r]:
                if places[r]:
                    for p in part.tolist():
                        heapq.heappush(places[r], p)
                else:
                    places[r] = sorted(part.tolist())
            else:
                places[r].append(part)

        def one(p: int) -> None:
            """Merge the pair at p, and look at its neighbours again."""
            q = int(after[p])
            sym[p] = made[p]
            alive[q] = False
            after[p] = after[q]
            if after[q] < n:
                before[after[q]] = p
            for x in (p, int(before[p])):
                if x >= 0:
                    rank[x], made[x] = self.pairs.get(int(sym[x]) * self.wide + int(sym[after[x]]), (_NONE, 0)) if after[x] < n else (_NONE, 0)
                    if rank[x] < _NONE:
                        put(int(rank[x]), np.array([x]))

        add(np.arange(n))
        while ranks:
            r = ranks[0]
            if self.late[r]:
                while places[r] and ranks[0] == r:
                    p = heapq.heappop(places[r])
                    if alive[p] and rank[p] == r:
                        one(p)
                if ranks[0] == r:
                    heapq.heappop(ranks)
                    del places[r]
                continue
            heapq.heappop(ranks)
            at = np.unique(np.concatenate(places.pop(r)))
            at = at[alive[at] & (rank[at] == r)]
            if not len(at):
                continue
            run = np.concatenate([[True], after[at[:-1]] != at[1:]])
            nth = np.arange(len(at))
            at = at[(nth - np.maximum.accumulate(np.where(run, nth, 0))) % 2 == 0]
            right = after[at]
            sym[at], alive[right], after[at] = made[at], False, after[right]
            inner = at[after[at] < n]
            before[after[inner]] = inner
            rank[at] = _NONE
            left = before[at]
            add(np.unique(np.concatenate([at, left[left >= 0]])))
        return sym[alive]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word, as little-endian 32-bit numbers; a word has a character at least and stands alone."""
        if not words:
            return []
        sym = self.symbol_of[code_points("".join(words))]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(words)), sizes)
        many = sizes > self.long
        out = [self.rounds(sym[~many[owner]], owner[~many[owner]])]
        out += [(x := self.long_rounds(sym[starts[k] : starts[k] + sizes[k]]), np.full(len(x), k)) for k in np.flatnonzero(many).tolist()]
        sym, owner = (np.concatenate(x) for x in zip(*out, strict=True))
        if len(out) > 1:
            order = np.argsort(owner, kind="stable")
            sym, owner = sym[order], owner[order]
        # characters that no piece holds are spelt in bytes
        odd = sym >= self.size
        chars = [chr(c) for c in (sym[odd] - self.size).tolist()]
        times = np.ones(len(sym), np.int64)
        times[odd] = [len(c.encode()) for c in chars]
        ids = np.repeat(sym, times)
        ids[np.repeat(odd, times)] = self.byte_ids[np.frombuffer("".join(chars).encode(), np.uint8)]
        count = np.bincount(np.repeat(owner, times), minlength=len(words))
        raw, cuts = ids.astype("<u4").tobytes(), [0, *(np.cumsum(count) * 4).tolist()]
        return [raw[a:b] for a, b in zip(cuts, cuts[1:])]

    def cuts(self, codes: np.ndarray) -> np.ndarray:
        """Whether a word starts at each character but the first: no piece has it beside the one before."""
        left, right = codes[:-1], codes[1:]
        found = self.low[np.minimum(left, _LOW - 1), np.minimum(right, _LOW - 1)]
        high = np.flatnonzero((left >= _LOW - 1) | (right >= _LOW - 1))
        if len(high):
            pair = left[high] << 21 | right[high]
            found[high] = self.beside[np.minimum(np.searchsorted(self.beside, pair), len(self.beside) - 1)] == pair
        return ~found

    def sections(self, text: str) -> list[str]:
        """A text in parts of about ``SECTION`` characters that end where words do."""
        out, start = [], 0
        while len(text) - start > SECTION:
            stop = start + SECTION
            while stop < len(text):
                at = np.flatnonzero(self.cuts(code_points(text[stop - 1 : stop + SECTION])))
                stop = stop + int(at[0]) if len(at) else min(len(text), stop + SECTION)
                if len(at):
                    break
            out.append(text[start:stop])
            start = stop
        return [*out, text[start:]] if start < len(text) else out

    def encode_sections(self, parts: list[str]) -> list[bytes]:
        """Ids of each part, word by word; words that were met before are remembered."""
        whole = "".join(parts)
        codes = code_points(whole)
        starts = np.concatenate([[True], self.cuts(codes)])
        firsts = np.cumsum([len(p) for p in parts[:-1]], dtype=np.int64)
        starts[firsts] = True
        at = np.flatnonzero(starts)
        edges = at.tolist()
        words = [whole[a:b] for a, b in zip(edges, [*edges[1:], len(whole)])]
        wanted = set(words)
        new = [w for w in wanted if w not in self.known]
        made = dict(zip(new, self.encode_words(new), strict=True))
        short = {w: x for w, x in made.items() if len(w) <= CACHE_CHARS}
        if len(self.known) + len(short) > CACHE_WORDS:
            self.known = {w: self.known[w] for w in wanted if w in self.known}
        self.known |= short
        if len(short) < len(made):
            ids = [made[w] if w in made else self.known[w] for w in words]
        else:
            ids = list(map(self.known.__getitem__, words))
        bounds = [0, *np.searchsorted(at, firsts).tolist(), len(words)]
        return [b"".join(ids[a:b]) for a, b in zip(bounds, bounds[1:])]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts with begin and end ids, as little-endian 32-bit numbers."""
        owner, parts = [], []
        for k, t in enumerate(texts):
            some = self.sections(SPACE + t.replace(" ", SPACE)) if t else []
            owner += [k] * len(some)
            parts += some
        begin, end = (np.array([i], "<u4").tobytes() for i in (self.begin, self.end))
        out = [[begin] for _ in texts]
        for a, b in by_bytes(parts, SECTION):
            for k, x in zip(owner[a:b], self.encode_sections(parts[a:b]), strict=True):
                out[k].append(x)
        return [b"".join([*x, end]) for x in out]

    def decode(self, ids: bytes) -> str:
        """Text of ids: the first piece loses its leading space, control ids are nothing, bytes that are no UTF-8 become U+FFFD one by one."""
        row = np.frombuffer(ids, "<u4").tolist()
        first = next((k for k, i in enumerate(row) if self.kinds[i] != CONTROL), len(row))
        parts = list(map(self.bytes_of.__getitem__, row))
        if first < len(row) and self.kinds[row[first]] == NORMAL and parts[first][:1] == b" ":
            parts[first] = parts[first][1:]
        try:
            return b"".join(parts).decode()
        except UnicodeDecodeError:
            return self.mended(row, parts)

    def mended(self, row: list[int], parts: list[bytes]) -> str:
        out, k = [], 0
        while k < len(row):
            if self.kinds[row[k]] != BYTE:
                out.append(parts[k].decode())
                k += 1
                continue
            stop = k
            while stop < len(row) and self.kinds[row[stop]] == BYTE:
                stop += 1
            raw, k = b"".join(parts[k:stop]), stop
            while raw:
                size = next((n for n in range(1, 5) if _is_character(raw[:n])), 0)
                out.append(raw[:size].decode() if size else "�")
                raw = raw[size or 1 :]
        return "".join(out)


def _is_character(raw: bytes) -> bool:
    try:
        return len(raw.decode()) == 1
    except UnicodeDecodeError:
        return False


@functools.lru_cache(maxsize=1)
def encoder_of(path: str) -> PieceEncoder:
    """One encoder a worker process, so that its tasks share what it remembers."""
    return PieceEncoder(path)


def piece_digests(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Encode and decode every text: doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]; begin and end ids count.

    Null texts count as empty (the two ids alone).  Rows are independent: repeated rows and null ids
    give rows of their own, other columns are ignored whatever their names, an empty table gives
    none.  A text is encoded whole however long it is.
    """
    path = path or public_tokenizers.path("piece_bpe_32k.model")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder = encoder_of(path)
        texts = batch.column(1).to_pylist()
        count, first, second, ids = [], [], [], []
        for a, b in by_bytes(texts, 1 << 21):
            for x in encoder.encode(texts[a:b]):
                count.append(len(x) // 4)
                first.append(hashlib.sha256(x).hexdigest())
                second.append(hashlib.sha256(encoder.decode(x).encode()).hexdigest())
                if with_ids:
                    ids.append(np.frombuffer(x, "<i4"))
        cols = {"doc_id": batch.column(0), "n_tokens": pa.array(count, pa.int64()), "ids_sha256": pa.array(first), "decoded_sha256": pa.array(second)}
        return pa.RecordBatch.from_pydict(cols | ({"ids": pa.array(ids, pa.list_(pa.int32()))} if with_ids else {}))

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text")), run, schema)
