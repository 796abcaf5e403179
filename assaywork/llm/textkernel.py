"""Vectorised work on the bytes of a batch of texts, for use inside Arrow tasks.

A text column arrives as one Arrow buffer with offsets. ``chunks`` cuts it into runs of whole
texts of about a megabyte, so memory is bounded by that and by the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RANDOM = np.random.Generator(np.random.PCG64(20240229))
#: Random 64-bit value of each byte, and odd 64-bit weight of each place in a word.
BYTE = _RANDOM.integers(1, 2**64 - 1, 256, dtype=np.uint64)
PLACE = _RANDOM.integers(1, 2**64 - 1, 1 << 14, dtype=np.uint64) | np.uint64(1)
#: Multipliers that join the hashes of neighbouring words.
JOIN = _RANDOM.integers(1, 2**64 - 1, 64, dtype=np.uint64) | np.uint64(1)

WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: ASCII letters and digits, and every byte of a character beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(x: np.ndarray) -> np.ndarray:
    """Values in (0, 1) from mixed 64-bit values."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


@dataclass
class Chunk:
    """Texts ``lo`` to ``hi`` of a batch: their bytes, and where each starts (one more offset)."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray


def chunks(column: pa.Array | pa.ChunkedArray, most: int = 1 << 20) -> Iterator[Chunk]:
    """Null texts count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield Chunk(lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


@dataclass
class Words:
    """``doc``: each word's text, as an index into the chunk, ascending; ``hash``: of its bytes;
    ``stems``: of its first bytes, for each length asked for."""

    doc: np.ndarray
    hash: np.ndarray
    stems: list[np.ndarray]


def words(c: Chunk, apart: np.ndarray, fold: bool = False, stems: tuple[int, ...] = ()) -> Words:
    """The words of each text: longest runs of bytes that ``apart`` doesn't mark.

    fold: A-Z count as a-z. No word crosses from one text into the next."""
    inside = ~apart[c.data]
    at = np.flatnonzero(inside)
    if not len(at):
        none = np.zeros(0, np.uint64)
        return Words(np.zeros(0, np.int64), none, [none] * len(stems))
    first = np.empty(len(at), bool)
    first[0] = True
    np.not_equal(at[1:], at[:-1] + 1, out=first[1:])
    edge = np.searchsorted(at, c.offsets[1:-1])
    edge = edge[edge < len(at)]
    first[edge] = True  # the first word byte at or after a text's start
    starts = np.flatnonzero(first)
    place = np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))
    value = (BYTE[LOWER] if fold else BYTE)[c.data[at]] * PLACE[place & (len(PLACE) - 1)]
    doc = np.searchsorted(c.offsets, at[starts], "right") - 1
    short = [mix(np.add.reduceat(np.where(place < n, value, np.uint64(0)), starts) + np.uint64(n)) for n in stems]
    return Words(doc, mix(np.add.reduceat(value, starts)), short)


def gram(hashes: np.ndarray, *steps: int) -> np.ndarray:
    """The joint hash of the words at i + step for each step, for every i that allows it."""
    n = len(hashes) - max(steps)
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k, s in enumerate(steps):
        total += hashes[s : s + n] * JOIN[k + 8 * (len(steps) - 1) % 56]
    return mix(total + np.uint64(sum(s << (8 * k) for k, s in enumerate(steps)) % (1 << 62)))
