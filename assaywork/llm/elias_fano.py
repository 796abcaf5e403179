"""Elias-Fano sequences and an n-gram trie of such levels, as flat arrays that can be mapped.

A monotone sequence of n values under u takes about 2 + log2(u / n) bits a value: the low bits are
packed, the high bits are written in unary. All queries are vectorised over many at a time. The first query of
a sequence makes the directories of its ones and zeros, 8 bytes each, which later ones look up."""

from __future__ import annotations

from functools import cached_property

import numpy as np


class EliasFano:
    def __init__(self, n: int, shift: int, low: np.ndarray, high: np.ndarray):
        self.n, self.shift, self.low, self.high = n, shift, low, high

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        """Of ascending values (int64, from 0)."""
        n = len(values)
        if (values[1:] < values[:-1]).any():
            raise ValueError("values don't ascend")
        most = int(values[-1]) if n else 0
        shift = max(0, (most // n).bit_length() - 1) if n else 0
        bits = np.zeros(((n + (most >> shift)) // 64 + 1) * 64, np.uint8)
        bits[(values >> shift) + np.arange(n)] = 1
        high = np.packbits(bits, bitorder="little").view(np.uint64)
        low = np.zeros(n * shift // 64 + 2, np.uint64)
        if shift:
            rest = values.astype(np.uint64) & np.uint64((1 << shift) - 1)
            bit = np.arange(n, dtype=np.int64) * shift
            word, off = bit >> 6, (bit & 63).astype(np.uint64)
            np.bitwise_or.at(low, word, rest << off)
            over = off + np.uint64(shift) > 64
            np.bitwise_or.at(low, word[over] + 1, rest[over] >> (np.uint64(64) - off[over]))
        return cls(n, shift, low, high)

    @cached_property
    def _bits(self) -> np.ndarray:
        return np.unpackbits(self.high.view(np.uint8), bitorder="little").view(bool)

    @cached_property
    def _top(self) -> np.ndarray:
        """High bits of each value: the zeros before its one."""
        return np.flatnonzero(self._bits) - np.arange(self.n)

    @cached_property
    def _first(self) -> np.ndarray:
        """The first place whose high bits are at least 0, 1, ...: the ones before the zero in front."""
        zeros = np.flatnonzero(~self._bits)
        return np.append(0, zeros - np.arange(len(zeros)))

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.shift:
            return np.zeros(len(i), np.int64)
        bit = i * self.shift
        word, off = bit >> 6, (bit & 63).astype(np.uint64)
        v = self.low[word] >> off
        over = off + np.uint64(self.shift) > 64
        if over.any():
            v[over] |= self.low[word[over] + 1] << (np.uint64(64) - off[over])
        return (v & np.uint64((1 << self.shift) - 1)).astype(np.int64)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self._top[i] << self.shift) | self._low(i)

    def successor(self, x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The first place in [lo, hi) whose value is at least x; hi if there is none. The high bits
        of x narrow the range to the values that share them, which is then halved by their low bits."""
        if not self.n or not len(x):
            return hi.copy()
        top = x >> self.shift
        a, b = (np.clip(self._first[np.clip(t, 0, len(self._first) - 1)], lo, hi) for t in (top, top + 1))
        open_ = np.flatnonzero(a < b)
        rest = x[open_] & ((1 << self.shift) - 1)
        while len(open_):
            mid = (a[open_] + b[open_]) >> 1
            less = self._low(mid) < rest
            a[open_] = np.where(less, mid + 1, a[open_])
            b[open_] = np.where(less, b[open_], mid)
            left = a[open_] < b[open_]
            open_, rest = open_[left], rest[left]
        return a

    def arrays(self) -> list[np.ndarray]:
        return [np.array([self.n, self.shift, len(self.low), len(self.high)], np.uint64), self.low, self.high]


class Trie:
    """Levels of n-grams: the first words, then the successors of each n-gram of the level before, with
    monotone pointers to their ranges, and 16-bit codes of each n-gram of each level.

    Successors are kept relative to what they follow: a base, the last value before their range plus one,
    is added, which makes a level one monotone sequence."""

    def __init__(self, values: list[EliasFano], pointers: list[EliasFano], codes: list[np.ndarray]):
        self.values, self.pointers, self.codes = values, pointers, codes

    @classmethod
    def of(cls, first: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]], codes: list[np.ndarray]) -> Trie:
        """first: ascending words; levels: for each further one (place in the level before, word), in
        order; every place has a successor. codes: an array a level, the first level left out, a row each."""
        values, pointers = [EliasFano.of(first)], []
        for parent, word in levels:
            starts = np.flatnonzero(np.diff(parent, prepend=-1)) if len(parent) else np.zeros(0, np.int64)
            ends = np.append(starts[1:], len(parent)).astype(np.int64)
            widths = word[ends - 1] + 1 if len(starts) else np.zeros(0, np.int64)
            values.append(EliasFano.of(word + np.repeat(np.cumsum(widths) - widths, ends - starts)))
            pointers.append(EliasFano.of(np.append(starts, len(parent))))
        return cls(values, pointers, [(c if c.ndim == 2 else c[:, None]).astype(np.uint16) for c in codes])

    def find(self, level: int, parent: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Places of words after the given places of the level before (-1: none), -1 where not there.
        The first level (0) has no parent."""
        v, out = self.values[level], np.full(len(word), -1, np.int64)
        for lo in range(0, len(word), 200_000):
            self._find(v, level, parent[lo : lo + 200_000], word[lo : lo + 200_000], out[lo : lo + 200_000])
        return out

    def _find(self, v: EliasFano, level: int, parent: np.ndarray, word: np.ndarray, out: np.ndarray) -> None:
        pick = np.flatnonzero(parent >= 0) if level else np.arange(len(word))
        if not v.n or not len(pick):
            return
        if level:
            own = parent[pick]
            lo, hi = self.pointers[level - 1].get(own), self.pointers[level - 1].get(own + 1)
            base = np.where(lo > 0, v.get(np.maximum(lo - 1, 0)) + 1, 0)
        else:
            base = lo = np.zeros(len(pick), np.int64)
            hi = np.full(len(pick), v.n, np.int64)
        target = base + word[pick]
        found = v.successor(target, lo, hi)
        hit = found < hi
        hit[hit] = v.get(found[hit]) == target[hit]
        out[pick[hit]] = found[hit]

    def to_bytes(self) -> bytes:
        parts = [np.array([len(self.values)], np.uint64)] + [x for e in (*self.values, *self.pointers) for x in e.arrays()]
        return b"".join(x.tobytes() for x in parts) + b"".join(np.array(c.shape, np.uint64).tobytes() + c.tobytes() + bytes(-c.nbytes % 8) for c in self.codes)

    @classmethod
    def from_buffer(cls, data: np.ndarray) -> Trie:
        """Over bytes (a mapped file, say); levels are views, not copies."""
        levels, at, read = int(data[:8].view(np.uint64)[0]), 8, []
        for _ in range(2 * levels - 1):
            n, shift, a, b = (int(x) for x in data[at : at + 32].view(np.uint64))
            at += 32
            read.append(EliasFano(n, shift, data[at : at + 8 * a].view(np.uint64), data[at + 8 * a : at + 8 * (a + b)].view(np.uint64)))
            at += 8 * (a + b)
        codes = []
        for _ in range(levels - 1):
            n, k = (int(x) for x in data[at : at + 16].view(np.uint64))
            codes.append(data[at + 16 : at + 16 + 2 * n * k].view(np.uint16).reshape(n, k))
            at += 16 + (2 * n * k + 7) // 8 * 8
        return cls(read[:levels], read[levels:], codes)
