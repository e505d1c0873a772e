"""Words, spans and their hashes for whole Arrow batches, in numpy.

Texts are read as the UTF-8 bytes that Arrow holds, all documents of a chunk at once. A word
is a run of bytes other than space and ``\\t \\n \\v \\f \\r``, which is ``[^\\x20\\x09-\\x0D]+``
on the text, as bytes of longer UTF-8 sequences are never in that range.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer document is a chunk of its own.
CHUNK = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1
U64 = np.uint64


def table(chars: bytes, rest: bool) -> np.ndarray:
    """256 flags: ``not rest`` for the bytes of ``chars``, ``rest`` for all others."""
    flags = np.full(256, rest)
    flags[list(chars)] = not rest
    return flags


WORD = table(b" \t\n\v\f\r", True)
LETTER = table(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)), False)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Chunk(NamedTuple):
    """Some documents: rows ``first`` up to ``last`` of the batch, their bytes and where each starts."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray


def chunks(column: pa.Array, most: int = CHUNK, rows: int = 256) -> Iterator[Chunk]:
    """Cut a string column into chunks of at most ``rows`` whole documents; nulls are empty texts."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        last = min(last, first + rows, len(column))
        yield Chunk(first, last, data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first])
        first = last


class Spans(NamedTuple):
    """Runs of bytes: where they start and end, and for each document the number of its first run."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def owners(self) -> np.ndarray:
        """The document of each run, counted from 0."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def spans(data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray) -> Spans:
    """Maximal runs of wanted bytes; no run goes over the edge of a document."""
    inside = wanted[data]
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    filled = offsets[:-1][np.diff(offsets) > 0]
    begin[filled] = inside[filled]
    tails = offsets[1:][np.diff(offsets) > 0] - 1
    end[tails] = inside[tails]
    starts = np.flatnonzero(begin)
    return Spans(starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets))


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64."""
    up = np.full(n, BASE, U64)
    down = np.full(n, pow(BASE, -1, 1 << 64), U64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (the finalizer of splitmix64)."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


class Hasher:
    """Hashes of any runs of bytes of one chunk, each in constant time after one pass."""

    def __init__(self, data: np.ndarray):
        size = 1 << max(21, int(len(data)).bit_length())
        up, self.down = _powers(size)
        self.sums = np.zeros(len(data) + 1, U64)
        np.cumsum((data.astype(U64) + U64(1)) * up[:len(data)], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts])


def windows(hashes: np.ndarray, first: np.ndarray, width: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of ``width`` consecutive words of one document.

    Returns the hashes, the number of the first word of each, and for each document the
    number of its first window. Documents of fewer words have none.
    """
    n = len(hashes)
    counts = np.maximum(np.diff(first) - width + 1, 0)
    begins = np.concatenate([[0], np.cumsum(counts)])
    if n < width:
        return np.zeros(0, U64), np.zeros(0, np.int64), begins
    rolled = np.full(n - width + 1, (seed * 2 + 1) & ((1 << 64) - 1), U64)
    for i in range(width):
        rolled = rolled * U64(0xD6E8FEB86659FD93) + hashes[i:n - width + 1 + i]
        rolled ^= rolled >> U64(32)
    at = np.arange(begins[-1]) + np.repeat(first[:-1] - begins[:-1], counts)
    return mix(rolled[at]), at, begins


def cover(n: int, starts: np.ndarray, width: int) -> np.ndarray:
    """Flags of ``n`` places that lie in a run of ``width`` places from one of ``starts``."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + width, n), -1)
    return np.cumsum(edge[:n]) > 0
