"""Elias-Fano sequences over plain arrays, searched for whole vectors of queries at a time.

A sequence of n ascending numbers below a universe keeps ``bits`` low bits of each number side by
side and the rest in unary: about 2 + log2(universe / n) bits a number. A directory of ones
before every 512 bits makes ``select`` a bisection and eight population counts. All
arrays may be slices of a memory map.
"""

from __future__ import annotations

import struct

import numpy as np

_HEAD = struct.Struct("<QQQQQ")
_STEP = 8  # words between entries of the directory
_HALVES = (32, 16, 8, 4, 2, 1)


def _packed(bits: np.ndarray) -> np.ndarray:
    raw = np.packbits(bits, bitorder="little")
    out = np.zeros((len(raw) + 7) // 8 * 8 + 8 * (_STEP + 1), np.uint8)
    out[: len(raw)] = raw
    return out.view(np.uint64)


def build(values: np.ndarray, universe: int) -> bytes:
    """The bytes of a sequence; values ascend (repeats allowed) and are below the universe."""
    n, values = len(values), values.astype(np.uint64)
    bits = max(0, (universe // n).bit_length() - 1) if n else 0
    low = _packed(((values[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel())
    size = n + (universe >> bits) + 1
    high = np.zeros(size, np.uint8)
    high[(values >> np.uint64(bits)).astype(np.int64) + np.arange(n)] = 1
    high = _packed(high)
    ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high).astype(np.int64))])[:: _STEP][: max(1, -(-len(high) // _STEP))].astype(np.uint64)
    return _HEAD.pack(n, bits, len(low), len(high), len(ones)) + low.tobytes() + high.tobytes() + ones.tobytes()


class EliasFano:
    def __init__(self, data: np.ndarray) -> None:
        """data: bytes of ``build`` as a uint8 array."""
        self.n, self.bits, a, b, c = _HEAD.unpack(bytes(data[: _HEAD.size]))
        words = data[_HEAD.size : _HEAD.size + 8 * (a + b + c)].view(np.uint64)
        self.low, self.high = words[:a], words[a : a + b]
        self.ones = np.asarray(words[a + b : a + b + c]).astype(np.int64)
        self.zeros = np.arange(len(self.ones), dtype=np.int64) * (64 * _STEP) - self.ones
        self.mask = np.uint64((1 << self.bits) - 1)

    def _select(self, i: np.ndarray, before: np.ndarray, flip: bool) -> np.ndarray:
        block = np.searchsorted(before, i, "right") - 1
        rest, word = i - before[block], block * _STEP
        top = len(self.high) - 1
        for _ in range(_STEP - 1):
            w = self.high[np.minimum(word, top)]
            c = np.bitwise_count(~w if flip else w).astype(np.int64)
            go = rest >= c
            rest = rest - c * go
            word = word + go
        w = self.high[np.minimum(word, top)]
        if flip:
            w = ~w
        at = word * 64
        for half in _HALVES:
            c = np.bitwise_count(w & np.uint64((1 << half) - 1)).astype(np.int64)
            go = rest >= c
            rest = rest - c * go
            step = go * half
            w = w >> step.astype(np.uint64)
            at = at + step
        return at

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        off = i * self.bits
        w, s = off >> 6, (off & 63).astype(np.uint64)
        v = self.low[w] >> s
        wide = s > np.uint64(64 - self.bits)
        v = np.where(wide, v | (self.low[w + 1] << ((np.uint64(64) - s) & np.uint64(63))), v)
        return v & self.mask

    def access(self, i: np.ndarray) -> np.ndarray:
        return ((self._select(i, self.ones, False) - i) << self.bits) | self._low(i).astype(np.int64)

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of the first number that isn't below x, and whether it equals x; x is below the universe."""
        h = x >> self.bits
        want = x.astype(np.uint64) & self.mask
        lo = np.where(h > 0, self._select(np.maximum(h - 1, 0), self.zeros, True) + 1 - h, 0)
        end = self._select(h, self.zeros, True) - h
        hi = end.copy()
        while (open_ := lo < hi).any():
            mid = (lo + hi) >> 1
            less = open_ & (self._low(np.minimum(mid, max(0, self.n - 1))) < want)
            lo = np.where(less, mid + 1, lo)
            hi = np.where(open_ & ~less, mid, hi)
        same = lo < end
        same[same] = self._low(lo[same]) == want[same]
        return lo, same


def bundle(parts: dict[str, bytes]) -> bytes:
    """Named byte strings in one, each at a multiple of 8 bytes."""
    head, body, at = [], [], 0
    for name, data in parts.items():
        pad = -len(data) % 8
        head.append(struct.pack("<16sQQ", name.encode(), at, len(data)))
        body.append(data + b"\0" * pad)
        at += len(data) + pad
    return struct.pack("<Q", len(parts)) + b"".join(head) + b"".join(body)


def unbundle(data: np.ndarray) -> dict[str, np.ndarray]:
    n = struct.unpack("<Q", bytes(data[:8]))[0]
    start, out = 8 + 32 * n, {}
    for k in range(n):
        name, at, size = struct.unpack("<16sQQ", bytes(data[8 + 32 * k : 40 + 32 * k]))
        out[name.rstrip(b"\0").decode()] = data[start + at : start + at + size]
    return out
