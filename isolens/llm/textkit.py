"""Texts of an Arrow batch as byte arrays: tokens and their 64-bit hashes without a Python loop over tokens.

A batch is cut into chunks of about CHUNK bytes (a longer text makes a chunk of its own), so that the
arrays of eight bytes per character stay small whatever the batch holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 19

#: Word separators are space and the five controls from tab to carriage return, all of them one byte in UTF-8.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
WORD_CLASS = np.where(SPACE, 0, 1).astype(np.uint8)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class Chunk(NamedTuple):
    """Some texts, joined: row first is row `first` of the batch; text i is data[offsets[i]:offsets[i + 1]]."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def n(self) -> int:
        return len(self.offsets) - 1


class Tokens(NamedTuple):
    """Byte ranges of tokens, and the text (within the chunk) that each stands in."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[Chunk]:
    """The texts of a string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    n = len(column)
    if n == 0:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1
        to = min(n, max(to, at + 1))
        yield Chunk(at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


def runs(chunk: Chunk, classes: np.ndarray) -> Tokens:
    """Maximal runs of bytes of one class, within one text each; class 0 separates."""
    n = len(chunk.data)
    if n == 0:
        empty = np.zeros(0, np.int64)
        return Tokens(empty, empty, empty)
    kind = classes[chunk.data]
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(kind[1:], kind[:-1], out=new[1:])
    inner = chunk.offsets[:-1]
    new[inner[inner < n]] = True
    start = np.flatnonzero(new)
    end = np.append(start[1:], n)
    keep = kind[start] > 0
    start, end = start[keep], end[keep]
    return Tokens(start, end, np.searchsorted(chunk.offsets, start, side="right") - 1)


def words(chunk: Chunk) -> Tokens:
    return runs(chunk, WORD_CLASS)


@lru_cache(maxsize=4)
def _byte_values(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            full = np.full(n, base, np.uint64)
            full[0] = 1
            _powers[i] = np.multiply.accumulate(full)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Hasher:
    """Hashes of byte ranges of one chunk, each from two prefix sums."""

    def __init__(self, data: np.ndarray, seed: int = 1) -> None:
        n = len(data)
        up, self.down = _power(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_byte_values(seed)[data] * up[:n], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


def ngrams(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of each n tokens in a row of one text; the hash depends on their order."""
    if len(h) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    m = len(h) - n + 1
    out = h[:m].copy()
    for i in range(1, n):
        out = mix(out * np.uint64(0x9DDFEA08EB382D69) + h[i : i + m])
    at = np.flatnonzero(doc[:m] == doc[n - 1 :])
    return at, out[at]


def code_points(data: np.ndarray) -> np.ndarray:
    """Prefix counts of code points: p[j] - p[i] of them are in bytes i to j."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out


def texts_of(chunk: Chunk) -> Iterator[str]:
    raw = chunk.data.tobytes()
    for a, b in zip(chunk.offsets[:-1], chunk.offsets[1:]):
        yield raw[a:b].decode()
