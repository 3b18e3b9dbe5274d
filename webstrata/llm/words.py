"""Word hashes of whole batches of texts, in numpy.

A word is a maximal run of characters that aren't white space (Unicode).  Hashes are 64-bit and the
same everywhere, so they may be compared across tasks.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np

#: White space beyond ASCII, and the separators that Python alone counts.
_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
# Odd multipliers; any would do.
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << max(21, (n - 1).bit_length())
        for k, base in enumerate((_P, _P_INV)):
            a = np.full(size, np.uint64(base))
            a[0] = 1
            _powers[k] = np.multiply.accumulate(a)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Words(NamedTuple):
    hashes: np.ndarray  # of every word of the batch
    first: np.ndarray  # index of each text's first word, and the number of words
    starts: np.ndarray  # byte offsets inside its text
    ends: np.ndarray


def words(texts: list[str]) -> Words:
    raw = [
        (t if not _ODD_SPACE.search(t) else _ODD_SPACE.sub(lambda m: " " * len(m[0].encode()), t)).encode("utf-8", "surrogatepass") + b" "
        for t in texts
    ]
    data = np.frombuffer(b"".join(raw), np.uint8)
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    base = np.concatenate([[0], np.cumsum(sizes)])
    if not len(data):
        e = np.zeros(0, np.int64)
        return Words(e.astype(np.uint64), np.zeros(len(texts) + 1, np.int64), e, e)
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space])))
    starts, ends = edge[::2], edge[1::2]
    power, inverse = _power_tables(len(data) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)])])
    hashes = mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    first = np.searchsorted(starts, base)
    owner = np.repeat(np.arange(len(texts)), np.diff(first))
    return Words(hashes, first, starts - base[owner], ends - base[owner])


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on (shorter at the end: n - 1 positions fewer)."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    power, inverse = _power_tables(len(hashes) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * power[: len(hashes)])])
    return mix((total[n:] - total[:m]) * inverse[:m])
