"""Elias-Fano sequences in plain arrays, searched many values at a time."""

from __future__ import annotations

import json

import numpy as np

_STEPS = [(np.uint64(s), np.uint64((1 << s) - 1)) for s in (32, 16, 8, 4, 2, 1)]
_CHUNK = 1 << 18


def _words(bits: np.ndarray) -> np.ndarray:
    """0/1 octets as little-endian words, one spare word behind."""
    octets = np.packbits(bits, bitorder="little")
    out = np.zeros(len(octets) // 8 + 2, "<u8")
    out.view(np.uint8)[: len(octets)] = octets
    return out


def _within(words: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Position of the k-th set bit (from 0) of each word."""
    words, k, at = words.copy(), k.astype(np.uint64), np.zeros(len(words), np.int64)
    for step, low in _STEPS:
        below = np.bitwise_count(words & low).astype(np.uint64)
        up = k >= below
        k = np.where(up, k - below, k)
        words = np.where(up, words >> step, words)
        at += np.where(up, int(step), 0)
    return at


class EliasFano:
    """A non-decreasing sequence: low bits side by side, high bits in unary with a count per word."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.width, self.low, self.high, self.ones = n, width, low, high, ones
        self.zeros = None

    @staticmethod
    def build(values: np.ndarray, universe: int) -> EliasFano:
        values = values.astype(np.uint64)
        n = len(values)
        width = max(0, (universe // max(n, 1)).bit_length() - 1)
        shift = np.uint64(width)
        highs = (values >> shift).astype(np.int64)
        marks = np.zeros((int(highs[-1]) if n else 0) + n + 1, np.uint8)
        marks[highs + np.arange(n)] = 1
        high = _words(marks)
        parts = []
        for first in range(0, n if width else 0, _CHUNK):
            octets = values[first : first + _CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
            parts.append(np.packbits(np.unpackbits(octets, axis=1, bitorder="little")[:, :width].ravel(), bitorder="little"))
        packed = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
        low = np.zeros(len(packed) // 8 + 2, "<u8")
        low.view(np.uint8)[: len(packed)] = packed
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high))]).astype("<u4" if n < 1 << 32 else "<u8")
        return EliasFano(n, width, low, high, ones)

    def arrays(self, name: str) -> dict[str, np.ndarray]:
        head = np.array([self.n, self.width], "<i8")
        return {f"{name}.head": head, f"{name}.low": self.low, f"{name}.high": self.high, f"{name}.ones": self.ones}

    @staticmethod
    def read(arrays: dict[str, np.ndarray], name: str) -> EliasFano:
        n, width = map(int, arrays[f"{name}.head"])
        return EliasFano(n, width, arrays[f"{name}.low"], arrays[f"{name}.high"], arrays[f"{name}.ones"])

    def lows(self, at: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(at), np.uint64)
        bit = at.astype(np.int64) * self.width
        word, shift = bit >> 6, (bit & 63).astype(np.uint64)
        rest = np.where(shift > 0, self.low[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return ((self.low[word] >> shift) | rest) & np.uint64((1 << self.width) - 1)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        """Values at these places."""
        word = np.searchsorted(self.ones, at, "right") - 1
        place = word * 64 + _within(self.high[word], at - self.ones[word].astype(np.int64))
        return ((place - at).astype(np.uint64) << np.uint64(self.width)) | self.lows(at)

    def _after_zero(self, k: np.ndarray) -> np.ndarray:
        """How many values have a high part of at most k."""
        if self.zeros is None:
            self.zeros = np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones
        word = np.searchsorted(self.zeros, k, "right") - 1
        place = word * 64 + _within(~self.high[word], k - self.zeros[word])
        return place - k

    def find(self, values: np.ndarray, first: np.ndarray | int = 0, last: np.ndarray | None = None) -> np.ndarray:
        """Place of each value between its ``first`` and ``last`` place (excluded), or -1.

        The high part bounds the run in which the value can be; a binary search
        over low bits ends there.
        """
        if not self.n or not len(values):
            return np.full(len(values), -1, np.int64)
        values = values.astype(np.uint64)
        high = (values >> np.uint64(self.width)).astype(np.int64)
        top = int(self[np.array([self.n - 1])][0] >> np.uint64(self.width))
        known = high <= top
        high = np.where(known, high, 0)
        end = self._after_zero(high)
        start = np.where(high > 0, self._after_zero(np.maximum(high - 1, 0)), 0)
        start, end = np.maximum(start, first), np.minimum(end, self.n if last is None else last)
        stop, low = end.copy(), values & np.uint64((1 << self.width) - 1)
        open_ = np.flatnonzero(start < end)
        while len(open_):
            middle = (start[open_] + end[open_]) >> 1
            less = self.lows(middle) < low[open_]
            start[open_] = np.where(less, middle + 1, start[open_])
            end[open_] = np.where(less, end[open_], middle)
            open_ = open_[start[open_] < end[open_]]
        found = known & (start < stop)
        found[found] = self.lows(start[found]) == low[found]
        return np.where(found, start, -1)


def to_bytes(arrays: dict[str, np.ndarray]) -> bytes:
    """A header line of names, types and lengths, then the arrays, each from a multiple of 8."""
    head = json.dumps([[k, a.dtype.str, len(a)] for k, a in arrays.items()]).encode()
    head += b" " * (-(len(head) + 1) % 8) + b"\n"
    return head + b"".join(a.tobytes() + b"\0" * (-a.nbytes % 8) for a in arrays.values())


def from_buffer(octets: np.ndarray) -> dict[str, np.ndarray]:
    """Views into a buffer of :func:`to_bytes`, which may be a mapped file."""
    end = 0
    while (stop := np.flatnonzero(octets[end : end + 4096] == 10)).size == 0:
        end += 4096
    end += int(stop[0]) + 1
    arrays = {}
    for name, kind, n in json.loads(octets[:end].tobytes()):
        size = np.dtype(kind).itemsize * n
        arrays[name] = octets[end : end + size].view(kind)
        end += size + -size % 8
    return arrays
