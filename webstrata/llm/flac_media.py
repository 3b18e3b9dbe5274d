"""Media columns: FLAC streams, written as 8-bit mono samples in numpy, read whatever their form.

Many frames are worked on at once, sample by sample: encoder and decoder hold one lane a frame.
Streams written here have a fixed block size and a seek table with a point for every frame; the
lanes read such streams.  All others (more bits or channels, decorrelated stereo, wasted bits,
escaped partitions, either residual method, no seek table, changing block sizes) are read frame by
frame.  Both readers check the header CRC-8 and the frame CRC-16 of every frame they touch, and the
stream's MD5 where they read a whole stream that has one.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, text_column

#: Samples of a frame, and the sample rate that streams declare.
BLOCK, RATE = 1024, 8000
#: Payload bytes that are worked on at once.
CHUNK = 1 << 21
LPC_ORDER, LPC_BITS = 4, 12
LAST_BYTES = 64

#: Bytes that text holds most, the commonest first: the space, then letters in the order of type-setting machines.
COMMON = b" etaoinshrdlucmfwypvbgkqjxz"
# Fixed value: id of the stream's application block that says its samples are ranks of bytes.
RANKED = b"rnk1"


def _ranked() -> np.ndarray:
    """Sample (as unsigned byte) of each byte: 0, -1, 1, -2, 2, ... in order of rank; common ones first, the others by value."""
    order = np.array([*COMMON, *(b for b in range(256) if b not in COMMON)])
    rank = np.empty(256, np.int64)
    rank[order] = np.arange(256)
    return ((rank >> 1) ^ -(rank & 1)).astype(np.int8).view(np.uint8)


#: Signed samples of bytes and the way back: 128 is silence, or (``ranks``) common bytes are near silence, as companding has common levels.
SAMPLES = {"plain": np.arange(256, dtype=np.uint8) ^ np.uint8(0x80), "ranks": _ranked()}
BYTES = {k: np.argsort(v).astype(np.uint8) for k, v in SAMPLES.items()}

# Generators of the format's checksums.
CRC8_POLY, CRC16_POLY = 0x07, 0x8005


def _crc_table(poly: int, bits: int, width: int) -> np.ndarray:
    """Checksum of each value of ``width`` bits, for a register of ``bits``."""
    t = np.arange(1 << width, dtype=np.int64) << (bits - width)
    for _ in range(width):
        t = np.where(t >> (bits - 1) & 1, t << 1 ^ poly, t << 1) & ((1 << bits) - 1)
    return t


_CRC8 = _crc_table(CRC8_POLY, 8, 8).tolist()
_CRC16 = _crc_table(CRC16_POLY, 16, 8)
_CRC16_PAIR = _crc_table(CRC16_POLY, 16, 16).astype(np.uint16)
#: Leading zeros of 16-bit numbers.
_ZEROS = np.full(1 << 16, 16, np.int64)
for _b in range(16):
    _ZEROS[1 << _b : 2 << _b] = 15 - _b


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = _CRC8[c ^ b]
    return c


def crc16(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-16 of the first ``sizes`` bytes of each row; rows come longest first, with an even width."""
    pairs = np.ascontiguousarray(rows.view(">u2").astype(np.uint16).T)
    crc = np.zeros(len(rows), np.uint16)
    for t in range(int(sizes.max(initial=0)) // 2):
        k = int(np.searchsorted(-sizes, -2 * (t + 1), side="right"))
        crc[:k] = _CRC16_PAIR[crc[:k] ^ pairs[t, :k]]
    odd = np.flatnonzero(sizes % 2)
    last = rows[odd, sizes[odd] - 1].astype(np.int64)
    crc[odd] = (crc[odd].astype(np.int64) << 8 & 0xFFFF) ^ _CRC16[crc[odd].astype(np.int64) >> 8 ^ last]
    return crc


def coded_number(n: int) -> bytes:
    """A frame number, coded as UTF-8 codes characters, up to 36 bits."""
    if n < 0x80:
        return bytes([n])
    tail = []
    lead = 0x3F
    while n > lead:
        tail.append(0x80 | n & 0x3F)
        n >>= 6
        lead >>= 1
    return bytes([(~(lead * 2 + 1) & 0xFF) | n, *reversed(tail)])


def frame_header(number: int, size: int) -> bytes:
    head = b"\xff\xf8\x70\x02" + coded_number(number) + struct.pack(">H", size - 1)
    return head + bytes([crc8(head)])


class Frame(NamedTuple):
    """A frame's place and shape, read from its header and the start of its subframe."""

    size: int
    kind: int  # subframe type
    body: int  # offset of the subframe's type byte in the frame


class Foreign(ValueError):
    """A frame that the lanes don't read."""


def read_header(frame: bytes) -> Frame:
    if frame[:2] != b"\xff\xf8" or frame[3] != 0x02:
        raise Foreign("not a frame of 8-bit mono samples with fixed block size")
    at = 5
    while frame[at] & 0xC0 == 0x80:
        at += 1
    code = frame[2] >> 4
    if code == 7:
        size, at = (frame[at] << 8 | frame[at + 1]) + 1, at + 2
    elif code == 6:
        size, at = frame[at] + 1, at + 1
    else:
        size = 192 if code == 1 else 576 << (code - 2) if code < 6 else 256 << (code - 8)
    if crc8(frame[:at]) != frame[at]:
        raise ValueError("header checksum differs")
    if frame[at + 1] & 1:
        raise Foreign("wasted bits")
    return Frame(size, frame[at + 1] >> 1, at + 1)


def predict(samples: np.ndarray, sizes: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray | None]]:
    """Candidate predictors: (subframe type, residuals, coefficients with the shift in the last column)."""
    s = samples.astype(np.int64)
    out: list[tuple[int, np.ndarray, np.ndarray | None]] = [(8, s, None)]
    d = s
    for order in (1, 2):
        d = np.concatenate([d[:, :1] * 0, np.diff(d, axis=1)], axis=1)
        out.append((8 | order, d, None))
    # autocorrelation in integers, so that equal blocks get equal coefficients wherever they stand
    r = np.stack([(s[:, lag:] * s[:, : s.shape[1] - lag]).sum(axis=1) for lag in range(LPC_ORDER + 1)], axis=1).astype(np.float64)
    r[:, 0] = r[:, 0] * (1 + 2.0**-20) + 1
    a, err = np.zeros((len(s), LPC_ORDER)), r[:, 0].copy()
    for i in range(LPC_ORDER):
        k = r[:, i + 1].copy()
        for j in range(i):
            k -= a[:, j] * r[:, i - j]
        k /= err
        new = a.copy()
        new[:, i] = k
        for j in range(i):
            new[:, j] = a[:, j] - k * a[:, i - 1 - j]
        a, err = new, err * (1 - k * k)
    shift = LPC_BITS - 3
    q = np.clip(np.rint(a * (1 << shift)), -(1 << LPC_BITS - 1), (1 << LPC_BITS - 1) - 1).astype(np.int64)
    guess = np.zeros_like(s)
    for j in range(LPC_ORDER):
        guess[:, j + 1 :] += q[:, j : j + 1] * s[:, : s.shape[1] - j - 1]
    out.append((31 + LPC_ORDER, s - (guess >> shift), np.concatenate([q, np.full((len(s), 1), shift)], axis=1)))
    return out


def order_of(kind: int) -> int:
    return kind - 31 if kind >= 32 else kind & 7


def encode_frames(samples: np.ndarray, sizes: np.ndarray, numbers: list[int]) -> list[bytes]:
    """Frames of rows of signed samples (padded to one width); the smallest subframe of constant, verbatim, fixed and linear prediction."""
    n, width = samples.shape
    inside = np.arange(width)[None, :] < sizes[:, None]
    best, pick, rice = sizes * 8, np.ones(n, np.int64), np.zeros(n, np.int64)
    folded: dict[int, tuple[np.ndarray, np.ndarray | None]] = {}
    for kind, residual, coefs in predict(samples, sizes):
        order = order_of(kind)
        u = (residual << 1) ^ (residual >> 63)
        u[~inside] = 0
        u[:, :order] = 0
        folded[kind] = u.astype(np.uint32), coefs
        count, total = np.maximum(sizes - order, 1), u.sum(axis=1)
        k = np.zeros(n, np.int64)
        for b in range(1, 15):
            k += total > count * (1 << b) * 5 // 4
        cost = count * (k + 1) + (u >> k[:, None]).sum(axis=1) + 10 + order * 8 + (9 + order * LPC_BITS if kind >= 32 else 0)
        better = (cost < best) & (sizes > order)
        best, pick, rice = np.where(better, cost, best), np.where(better, kind, pick), np.where(better, k, rice)
    pick[(samples == samples[:, :1]).all(axis=1, where=inside)] = 0
    bodies: list[bytes] = [b""] * n
    for i in np.flatnonzero(pick == 0):
        bodies[i] = bytes([0, int(samples[i, 0]) & 0xFF])
    for i in np.flatnonzero(pick == 1):
        bodies[i] = b"\x02" + samples[i, : sizes[i]].astype(np.int8).tobytes()
    for kind, (u, coefs) in folded.items():
        rows = np.flatnonzero(pick == kind)
        if not len(rows):
            continue
        order, k, m = order_of(kind), rice[rows], len(rows)
        head = [(np.full(m, kind << 1), 8)] + [(samples[rows, t] & 0xFF, 8) for t in range(order)]
        if coefs is not None:
            head += [(np.full(m, LPC_BITS - 1), 4), (coefs[rows, -1], 5)] + [(coefs[rows, j] & (1 << LPC_BITS) - 1, LPC_BITS) for j in range(order)]
        head += [(np.zeros(m, np.int64), 6), (k, 4)]
        lead = sum(w for _, w in head)
        v, ok = u[rows].astype(np.int64), inside[rows]
        ok[:, :order] = False
        length = np.where(ok, (v >> k[:, None]) + 1 + k[:, None], 0)
        ends = lead + np.cumsum(length, axis=1)
        wide = -(-int(ends[:, -1].max()) // 8) * 8
        bits = np.zeros((m, wide), np.uint8)
        at = 0
        for value, w in head:
            for b in range(w):
                bits[:, at + b] = value >> (w - 1 - b) & 1
            at += w
        place = (np.arange(m)[:, None] * wide + ends - 1)[ok]
        ks = np.broadcast_to(k[:, None], v.shape)[ok]
        code = (v[ok] & ((1 << ks) - 1)) | (1 << ks)
        flat = bits.ravel()
        for b in range(int(k.max()) + 1):
            on = ks >= b
            flat[place[on] - b] = code[on] >> b & 1
        packed = np.packbits(bits, axis=1)
        for i, row, size in zip(rows.tolist(), packed, (-(-ends[:, -1] // 8)).tolist(), strict=True):
            bodies[i] = row[:size].tobytes()
    frames = [frame_header(x, s) + b for x, s, b in zip(numbers, sizes.tolist(), bodies, strict=True)]
    rows, length, order = lanes(frames)
    for i, c in zip(order.tolist(), crc16(rows, length).tolist(), strict=True):
        frames[i] += struct.pack(">H", c)
    return frames


def lanes(frames: list[bytes], spare: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Frames as rows of one width, longest first: (rows, lengths, index of each row's frame)."""
    size = np.fromiter(map(len, frames), np.int64, len(frames))
    order = np.argsort(-size, kind="stable")
    wide = (int(size.max()) + spare + 1) // 2 * 2
    return np.frombuffer(b"".join(frames[i].ljust(wide, b"\0") for i in order.tolist()), np.uint8).reshape(len(frames), wide), size[order], order


def encode_streams(payloads: list[bytes], block: int = BLOCK, levels: str = "plain") -> list[bytes]:
    """One FLAC stream a payload; no payload may be empty.  levels: a key of SAMPLES."""
    cuts = [(p, i, a) for p, data in enumerate(payloads) for i, a in enumerate(range(0, len(data), block))]
    pcm = [SAMPLES[levels][np.frombuffer(data, np.uint8)].tobytes() for data in payloads]
    frames: list[bytes] = []
    for c in range(0, len(cuts), max(1, CHUNK // block)):
        part = cuts[c : c + max(1, CHUNK // block)]
        sizes = np.array([min(block, len(pcm[p]) - a) for p, _, a in part])
        raw = b"".join(pcm[p][a : a + block].ljust(block, b"\0") for p, _, a in part)
        frames += encode_frames(np.frombuffer(raw, np.int8).reshape(len(part), block).astype(np.int64), sizes, [i for _, i, _ in part])
    mark = struct.pack(">I", 2 << 24 | len(RANKED)) + RANKED if levels == "ranks" else b""
    out, at = [], 0
    for data in pcm:
        mine = frames[at : at + -(-len(data) // block)]
        at += len(mine)
        points, offset = [], 0
        for i, f in enumerate(mine):
            points.append(struct.pack(">QQH", i * block, offset, min(block, len(data) - i * block)))
            offset += len(f)
        sizes = [len(f) for f in mine]
        rate = (RATE << 44) | (7 << 36) | len(data)
        info = struct.pack(">HH", max(16, block), max(16, block)) + min(sizes).to_bytes(3) + max(sizes).to_bytes(3) + rate.to_bytes(8) + hashlib.md5(data).digest()
        table = b"".join(points)
        out.append(b"fLaC" + struct.pack(">I", len(info)) + info + mark + struct.pack(">I", 0x83 << 24 | len(table)) + table + b"".join(mine))
    return out


class Stream(NamedTuple):
    data: bytes
    channels: int
    bits: int
    total: int  # samples of a channel, 0 if unknown
    md5: bytes
    points: list[tuple[int, int, int]]  # first sample, offset from the first frame, samples
    first: int
    levels: str = "plain"

    @property
    def laned(self) -> bool:
        """8-bit mono with a point for every frame."""
        ends = [s + n for s, _, n in self.points]
        return self.channels == 1 and self.bits == 8 and bool(ends) and [p[0] for p in self.points] == [0, *ends[:-1]] and ends[-1] == self.total

    def frames(self, start: int = 0, stop: int | None = None) -> list[bytes]:
        """The frames that hold samples start..stop, found by the seek table."""
        stop = self.total if stop is None else stop
        ends = [p[1] for p in self.points[1:]] + [len(self.data) - self.first]
        return [self.data[self.first + o : self.first + e] for (s, o, n), e in zip(self.points, ends, strict=True) if s < stop and s + n > start]


def open_stream(data: bytes) -> Stream:
    if data[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, last, points, info, levels = 4, False, [], b"", "plain"
    while not last:
        head = int.from_bytes(data[at : at + 4])
        last, kind, size = bool(head >> 31), head >> 24 & 0x7F, head & 0xFFFFFF
        block = data[at + 4 : at + 4 + size]
        if len(block) < size or at + 4 > len(data):
            raise ValueError("the stream is cut short")
        if kind == 0:
            info = block
        elif kind == 3:
            points = [p for p in struct.iter_unpack(">QQH", block) if p[0] != 0xFFFFFFFFFFFFFFFF]
        elif kind == 2 and block == RANKED:
            levels = "ranks"
        at += 4 + size
    if len(info) != 34:
        raise ValueError("the stream has no header block")
    packed = int.from_bytes(info[10:18])
    return Stream(data, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & (1 << 36) - 1, info[18:34], points, at, levels)


def decode_frames(frames: list[bytes]) -> list[bytes]:
    """Samples of each frame as signed bytes, checksums verified."""
    rows, length, order = lanes(frames)
    said = rows[np.arange(len(rows)), length - 2].astype(np.int64) << 8 | rows[np.arange(len(rows)), length - 1]
    heads = [read_header(f) for f in frames]
    if (crc16(rows, length - 2) != said).any():
        raise ValueError("a frame's checksum differs")
    out: list[bytes] = [b""] * len(frames)
    groups: dict[tuple[int, int], list[int]] = {}
    for i, (h, f) in enumerate(zip(heads, frames, strict=True)):
        if h.kind == 0:
            out[i] = f[h.body + 1 : h.body + 2] * h.size
        elif h.kind == 1:
            out[i] = f[h.body + 1 : h.body + 1 + h.size]
        elif 8 <= h.kind <= 12 or h.kind >= 32:
            # lanes of one group share precision and shift, which follow the warm-up samples
            at = h.body + 1 + order_of(h.kind)
            groups.setdefault((h.kind, int.from_bytes(f[at : at + 2]) >> 7 if h.kind >= 32 else 0), []).append(i)
        else:
            raise ValueError(f"subframe type {h.kind}")
    for (kind, _), members in groups.items():
        members.sort(key=lambda i: -heads[i].size)
        for i, row in zip(members, decode_lanes([frames[i][heads[i].body :] for i in members], np.array([heads[i].size for i in members]), kind), strict=True):
            out[i] = row
    return out


def decode_lanes(bodies: list[bytes], sizes: np.ndarray, kind: int) -> list[bytes]:
    """Predicted subframes of one type, largest first: Rice codes and prediction, one sample of every lane at a step."""
    n, order = len(bodies), order_of(kind)
    wide = max(map(len, bodies)) + 8
    raw = np.frombuffer(b"".join(b.ljust(wide, b"\0") for b in bodies), np.uint8).astype(np.uint32)
    words = np.zeros(len(raw) + 4, np.uint32)  # 32 bits from each byte on
    for b in range(4):
        words[: len(raw) - b] |= raw[b:] << np.uint32(24 - 8 * b)
    at = np.arange(n, dtype=np.int64) * (wide * 8) + 8

    def take(k: int, w: int) -> np.ndarray:
        p = at[:k]
        got = (words[p >> 3] << (p & 7).astype(np.uint32)) >> np.uint32(32 - w)
        at[:k] += w
        return got.astype(np.int64)

    signed = lambda v, w: v - ((v >> (w - 1)) << w)
    s = np.zeros((int(sizes[0]), n), np.int64)
    for t in range(order):
        s[t] = signed(take(n, 8), 8)
    coefs, shift = [], 0
    if kind >= 32:
        precision = int(take(n, 4)[0]) + 1
        shift = int(take(n, 5)[0])
        coefs = [signed(take(n, precision), precision) for _ in range(order)]
    elif order:
        coefs = [np.full(n, c) for c in FIXED[order]]
    if take(n, 2).any():
        raise Foreign("residual coding method")
    parts = 1 << take(n, 4)
    k = np.zeros(n, np.int64)
    active = np.searchsorted(-sizes, -np.arange(1, int(sizes[0]) + 1), side="right")
    each = sizes // parts
    turns = bool((parts > 1).any())
    for t in range(order, int(sizes[0])):
        a = int(active[t])
        if t == order or turns:
            new = np.flatnonzero((t == order) | (t % each[:a] == 0))
            if len(new):
                p = at[new]
                k[new] = (words[p >> 3] << (p & 7).astype(np.uint32)) >> np.uint32(28)
                at[new] += 4
                if (k[new] == 15).any():
                    raise Foreign("escaped partition")
        p = at[:a]
        x = words[p >> 3] << (p & 7).astype(np.uint32)
        q = _ZEROS[x >> np.uint32(16)]
        more = np.flatnonzero(q == 16)
        while len(more):
            far = p[more] + q[more]
            z = _ZEROS[(words[far >> 3] << (far & 7).astype(np.uint32)) >> np.uint32(16)]
            q[more] += z
            more = more[z == 16]
        p = p + q + 1
        ka = k[:a]
        x = (words[p >> 3] << (p & 7).astype(np.uint32)).astype(np.int64)
        u = q << ka | x >> (32 - ka)
        at[:a] = p + ka
        r = (u >> 1) ^ -(u & 1)
        if coefs:
            guess = coefs[0][:a] * s[t - 1, :a]
            for j in range(1, order):
                guess += coefs[j][:a] * s[t - 1 - j, :a]
            r += guess >> shift
        s[t, :a] = r
    done = np.ascontiguousarray(s.astype(np.int8).T)
    return [row[:m].tobytes() for row, m in zip(done, sizes.tolist(), strict=True)]


class Bits:
    """Bits of a frame, read from the highest on."""

    def __init__(self, data: bytes, at: int) -> None:
        self.data, self.at = data, at * 8

    def take(self, n: int) -> int:
        end = self.at + n
        if end > len(self.data) * 8:
            raise ValueError("the stream is cut short")
        value = int.from_bytes(self.data[self.at >> 3 : (end + 7) >> 3]) >> (-end & 7)
        self.at = end
        return value & ((1 << n) - 1)

    def signed(self, n: int) -> int:
        value = self.take(n)
        return value - (value >> (n - 1) << n) if n else 0

    def zeros(self) -> int:
        """Zeros up to the next one, which is read too."""
        n = 0
        while True:
            left = 8 - (self.at & 7)
            byte = self.take(left)
            if byte:
                used = left - byte.bit_length() + 1
                self.at -= left - used
                return n + used - 1
            n += left


# The format's codes of sample sizes, coefficients of its fixed predictors, channel codes of decorrelated stereo.
SAMPLE_BITS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))
LEFT_SIDE, SIDE_RIGHT, MID_SIDE = 8, 9, 10


def read_residuals(bits: Bits, size: int, order: int) -> list[int]:
    width = {0: 4, 1: 5}.get(bits.take(2))
    if width is None:
        raise ValueError("residual coding method")
    parts = 1 << bits.take(4)
    out: list[int] = []
    for p in range(parts):
        count = size // parts - (order if p == 0 else 0)
        k = bits.take(width)
        if k == (1 << width) - 1:
            raw = bits.take(5)
            out += [bits.signed(raw) for _ in range(count)]
            continue
        for _ in range(count):
            u = bits.zeros() << k | bits.take(k)
            out.append((u >> 1) ^ -(u & 1))
    return out


def read_subframe(bits: Bits, size: int, depth: int) -> np.ndarray:
    head = bits.take(8)
    kind, wasted = head >> 1, bits.zeros() + 1 if head & 1 else 0
    if head & 0x80:
        raise ValueError("no subframe")
    depth -= wasted
    if kind == 0:
        s = [bits.signed(depth)] * size
    elif kind == 1:
        s = [bits.signed(depth) for _ in range(size)]
    elif 8 <= kind <= 12 or kind >= 32:
        order = order_of(kind)
        s = [bits.signed(depth) for _ in range(order)]
        coefs, shift = FIXED[order] if kind < 32 else (), 0
        if kind >= 32:
            precision = bits.take(4) + 1
            shift = bits.signed(5)
            if precision == 16 or shift < 0:
                raise ValueError("linear predictor")
            coefs = [bits.signed(precision) for _ in range(order)]
        for r in read_residuals(bits, size, order):
            s.append(r + (sum(c * x for c, x in zip(coefs, reversed(s[len(s) - order :] if order else []))) >> shift))
    else:
        raise ValueError(f"subframe type {kind}")
    return np.array(s, np.int64) << wasted


def read_frame(stream: Stream, at: int) -> tuple[int, np.ndarray, int]:
    """(first sample, or the frame's number where block sizes are fixed; samples, one row a channel; place behind the frame)."""
    data = stream.data
    if int.from_bytes(data[at : at + 2]) & 0xFFFE != 0xFFF8:
        raise ValueError("no frame")
    code, rate, channel, depth = data[at + 2] >> 4, data[at + 2] & 15, data[at + 3] >> 4, SAMPLE_BITS.get(data[at + 3] >> 1 & 7, stream.bits)
    bits = Bits(data, at + 4)
    lead = bits.take(8)
    more = 8 - (lead ^ 0xFF).bit_length()
    number = lead & 0x7F >> more
    for _ in range(more - 1):
        number = number << 6 | bits.take(8) & 0x3F
    if code in (6, 7):
        size = bits.take(8 * (code - 5)) + 1
    else:
        size = 192 if code == 1 else 576 << (code - 2) if code < 6 else 256 << (code - 8)
    bits.take({12: 8, 13: 16, 14: 16}.get(rate, 0))
    if crc8(data[at : bits.at >> 3]) != bits.take(8):
        raise ValueError("header checksum differs")
    n = channel + 1 if channel < LEFT_SIDE else 2
    side = {LEFT_SIDE: 1, SIDE_RIGHT: 0, MID_SIDE: 1}.get(channel, -1)
    s = np.stack([read_subframe(bits, size, depth + (c == side)) for c in range(n)])
    if channel == LEFT_SIDE:
        s[1] = s[0] - s[1]
    elif channel == SIDE_RIGHT:
        s[0] += s[1]
    elif channel == MID_SIDE:
        mid = s[0] << 1 | s[1] & 1
        s[0], s[1] = (mid + s[1]) >> 1, (mid - s[1]) >> 1
    end = (bits.at + 7) >> 3
    frame = np.frombuffer(data[at:end].ljust(end - at + (end - at & 1), b"\0"), np.uint8)[None, :]
    if end + 2 > len(data) or int(crc16(frame, np.array([end - at]))[0]) != int.from_bytes(data[end : end + 2]):
        raise ValueError("a frame's checksum differs")
    return number, s, end + 2


def packed(samples: np.ndarray, bits: int) -> bytes:
    """Interleaved little-endian signed samples, as few whole bytes each as hold the bits."""
    wide = -(-bits // 8)
    return np.ascontiguousarray(samples.T.astype("<i8")).view(np.uint8).reshape(-1, 8)[:, :wide].tobytes()


class Pcm(NamedTuple):
    """A stream's samples: channels, bits of a sample, (first sample, samples, interleaved signed bytes) of every frame; what 8-bit samples stand for."""

    channels: int
    bits: int
    blocks: list[tuple[int, int, bytes]]
    levels: str


def read_frames(s: Stream, start: int = 0, stop: int | None = None) -> Iterator[tuple[int, int, bytes]]:
    """Frames one after another that hold samples start..stop, from the last seek point before them on."""
    first, at = max(((p[0], s.first + p[1]) for p in s.points if p[0] <= start), default=(0, s.first))
    while at < len(s.data) and (stop is None or first < stop) and (not s.total or first < s.total):
        _, samples, at = read_frame(s, at)
        if first + samples.shape[1] > start:
            yield first, samples.shape[1], packed(samples, s.bits)
        first += samples.shape[1]


def stream_blocks(streams: list[bytes]) -> list[Pcm]:
    """Every frame of each stream, every checksum verified."""
    opened = [open_stream(s) for s in streams]
    frames = [s.frames() if s.laned else [] for s in opened]
    flat = [f for fs in frames for f in fs]
    step = max(1, CHUNK // BLOCK)
    try:
        fast: list[bytes] | None = [b for c in range(0, len(flat), step) for b in decode_frames(flat[c : c + step])]
    except Foreign:
        if len(streams) > 1:
            return [x for s in streams for x in stream_blocks([s])]
        fast = None
    out, at = [], 0
    for s, fs in zip(opened, frames, strict=True):
        if s.laned and fast is not None:
            mine = fast[at : at + len(fs)]
            at += len(fs)
            starts = np.cumsum([0, *map(len, mine)])[:-1].tolist()
            if [p[0] for p in s.points] != starts:
                raise ValueError("the seek table differs from the stream's blocks")
            blocks = [(a, len(x), x) for a, x in zip(starts, mine, strict=True)]
        else:
            blocks = list(read_frames(s))
            if not {p[0] for p in s.points} <= {b[0] for b in blocks}:
                raise ValueError("the seek table differs from the stream's blocks")
        data = b"".join(x for _, _, x in blocks)
        if (s.total and sum(n for _, n, _ in blocks) != s.total) or (any(s.md5) and hashlib.md5(data).digest() != s.md5):
            raise ValueError("the stream's samples differ from its digest")
        out.append(Pcm(s.channels, s.bits, blocks, s.levels))
    return out


def decode_streams(streams: list[bytes]) -> list[bytes]:
    """Whole payloads of streams as ``encode_streams`` makes them, every checksum verified."""
    return [to_payload(b"".join(x for _, _, x in pcm.blocks), pcm.levels) for pcm in stream_blocks(streams)]


def seek_pcm(stream: bytes, start: int, stop: int) -> bytes:
    """Interleaved samples start..stop; only frames from the last seek point before them on are decoded."""
    s = open_stream(stream)
    size = s.channels * -(-s.bits // 8)
    hit: list[tuple[int, int, bytes]]
    try:
        if not s.laned:
            raise Foreign
        points = [p for p in s.points if p[0] < stop and p[0] + p[2] > start]
        hit = [(p[0], p[2], x) for p, x in zip(points, decode_frames(s.frames(start, stop)) if points else [], strict=True)]
    except Foreign:
        hit = list(read_frames(s, start, stop))
    return b"".join(x for _, _, x in hit)[(start - hit[0][0]) * size :][: (stop - start) * size] if hit else b""


def seek(stream: bytes, start: int, stop: int) -> bytes:
    """Payload bytes start..stop."""
    return to_payload(seek_pcm(stream, start, stop), open_stream(stream).levels)


def to_payload(pcm: bytes, levels: str = "plain") -> bytes:
    """Payload bytes of 8-bit samples."""
    return BYTES[levels][np.frombuffer(pcm, np.uint8)].tobytes()


def payload(text: str) -> tuple[int, bytes]:
    """(bytes of the text, text in UTF-8 with zeros up to a positive multiple of 64)."""
    raw = text.encode("utf-8", "replace")
    return len(raw), raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")


def feature(data: bytes, block: int = BLOCK) -> str:
    """Samples, mean, mean square and sign changes of payload bytes taken as plain 8-bit PCM, whatever levels their stream has."""
    s = np.frombuffer(data, np.uint8).astype(np.int64) - 128
    turns = int(np.count_nonzero((s[1:] < 0) != (s[:-1] < 0)))
    return f"n={len(s)};mean={s.sum() / len(s):.4f};power={(s * s).sum() / len(s):.4f};turns={turns};blocks={-(-len(s) // block)}"


def _parts(sizes: list[int]) -> list[tuple[int, int]]:
    out, start, total = [], 0, 0
    for i, s in enumerate(sizes):
        total += s
        if total >= CHUNK:
            out.append((start, i + 1))
            start, total = i + 1, 0
    return out + ([(start, len(sizes))] if start < len(sizes) else [])


def to_media(docs: DataFrame, levels: str = "ranks") -> DataFrame:
    """doc_id, n_bytes, media: each text's payload as a FLAC stream.  Null texts count as empty.

    levels: "plain" for bytes as they are, "ranks" for samples that are small where bytes are
    common in text, which Rice codes make shorter; the stream says which, and readers undo it.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [payload(t) for t in batch.column(1).to_pylist()]
        media = [m for a, b in _parts([len(p) for _, p in made]) for m in encode_streams([p for _, p in made[a:b]], levels=levels)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in made], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text"))
    return map_arrow(chosen, run, "doc_id long, n_bytes long, media binary")


def pcm_blocks(media: DataFrame) -> DataFrame:
    """doc_id, first_sample, n_samples, channels, bits, levels, pcm (interleaved signed little-endian): one row a frame, seekable by sample offset.

    media: (doc_id, media) with FLAC streams of any form; a null stream has no rows, a damaged one raises.
    levels: what 8-bit samples stand for, a name that ``to_payload`` takes to give the bytes back;
    "plain" for streams of other writers.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        ids, media = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        found = [x for a, b in _parts([len(m) for m in media]) for x in stream_blocks(media[a:b])]
        rows = [(i, first, n, pcm.channels, pcm.bits, pcm.levels, x) for i, pcm in zip(ids, found, strict=True) for first, n, x in pcm.blocks]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.binary())
        names = ["doc_id", "first_sample", "n_samples", "channels", "bits", "levels", "pcm"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names) if rows else None

    return map_arrow(media.select("doc_id", "media").where("media is not null"), run, "doc_id long, first_sample long, n_samples long, channels int, bits int, levels string, pcm binary")


def media_features(media: DataFrame) -> DataFrame:
    """Digests and features of (doc_id, n_bytes, media) as ``to_media`` makes them, from the decoded streams; rows without a stream go."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        media = batch.column(2).to_pylist()
        data = [d for a, b in _parts([len(m) for m in media]) for d in decode_streams(media[a:b])]
        cols = {
            "doc_id": batch.column(0),
            "n_bytes": batch.column(1),
            "payload_bytes": pa.array([len(d) for d in data], pa.int64()),
            "payload_sha256": pa.array([hashlib.sha256(d).hexdigest() for d in data]),
            "tail_crc32": pa.array([zlib.crc32(d[-LAST_BYTES:]) for d in data], pa.int64()),
            "media_bytes": pa.array([len(m) for m in media], pa.int64()),
            "media_sha256": pa.array([hashlib.sha256(m).hexdigest() for m in media]),
            "feature": pa.array([feature(d) for d in data]),
        }
        return pa.RecordBatch.from_pydict(cols)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_arrow(media.select("doc_id", "n_bytes", "media").where("media is not null"), run, schema)
