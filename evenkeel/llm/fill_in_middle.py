"""Fill-in-the-middle texts, cut at token boundaries that a compressed set holds.

A text is read as tokens, each the white space before a word with the word (or the white space at
the end of the text). The code points at which tokens end are kept as a set in the manner of
roaring bitmaps: the upper bits of a value pick a container, the lower 16 bits lie in it as a
sorted array, as a bitmap or as runs, whichever is smallest. Containers carry the number of values
up to their end, so the k-th boundary is found by a search over the containers and a select inside
one. Two selects on one set give both cuts of a text; the second one never rescans the text.

Digits of ``sha256(seed:doc_id)`` choose the cuts and the form, so a rerun gives the same texts:

* ``plain``: the text as it is (also if it is empty or holds one of the three marks);
* ``psm``: ``<P>``prefix``<S>``suffix``<M>``middle;
* ``spm``: ``<S>``suffix``<P>``prefix``<M>``middle.

``restored`` rebuilds the text from the output and the form.

Cases: a null text is an empty text; a null doc_id counts as the text ``null`` in the digest; rows
that repeat a doc_id get the same digits and are each cut in their own text; very long texts are
cut whole, one at a time; an empty table gives no rows. Columns besides doc_id and text can be
carried along, but not under the name of a result column (ValueError).
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.shared import by_batch, documents, extended, prepare
from evenkeel.llm.words import WORD, chunks, spans

# Marks of the three parts.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Values of a container; more than ``ARRAY`` of them are never kept as an array.
CONTAINER, ARRAY = 1 << 16, 4096

_RESULT = "doc_id long, output string, n long, form string, prefix_chars long, middle_chars long"


class ArrayContainer:
    """Sorted 16-bit values."""

    def __init__(self, low: np.ndarray):
        self.low = low.astype(np.uint16)

    def select(self, k: int) -> int:
        return int(self.low[k])


class BitmapContainer:
    """One bit for each of 65,536 values, with the number of bits before each 64-bit word."""

    def __init__(self, low: np.ndarray):
        flags = np.zeros(CONTAINER, np.uint8)
        flags[low] = 1
        self.words = np.packbits(flags, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(flags.reshape(-1, 64).sum(1, dtype=np.int64))])

    def select(self, k: int) -> int:
        at = int(np.searchsorted(self.before, k, "right")) - 1
        word = int(self.words[at])
        for _ in range(k - int(self.before[at])):
            word &= word - 1  # drop the lowest bit
        return at * 64 + (word & -word).bit_length() - 1


class RunContainer:
    """Runs of consecutive values: where each starts, and the values up to its end."""

    def __init__(self, starts: np.ndarray, lengths: np.ndarray):
        self.starts, self.ends = starts.astype(np.uint16), np.cumsum(lengths)

    def select(self, k: int) -> int:
        at = int(np.searchsorted(self.ends, k, "right"))
        return int(self.starts[at]) + k - (int(self.ends[at - 1]) if at else 0)


def container(low: np.ndarray) -> ArrayContainer | BitmapContainer | RunContainer:
    """The smallest of the three kinds for sorted distinct 16-bit values."""
    heads = np.flatnonzero(np.concatenate([[True], np.diff(low) != 1]))
    if 4 * len(heads) < min(2 * len(low), CONTAINER // 8):
        return RunContainer(low[heads], np.diff(np.append(heads, len(low))))
    return ArrayContainer(low) if len(low) <= ARRAY else BitmapContainer(low)


class BoundarySet:
    """A sorted set of positions with ``select``."""

    def __init__(self, values: np.ndarray):
        """``values`` are sorted and distinct."""
        high = values >> 16
        begins = np.flatnonzero(np.concatenate([[True], np.diff(high) != 0])) if len(values) else np.zeros(0, np.int64)
        ends = np.append(begins[1:], len(values))
        self.keys = high[begins].tolist()
        self.ranks = ends.tolist()
        self.containers = [container(values[a:b] & (CONTAINER - 1)) for a, b in zip(begins.tolist(), ends.tolist())]

    def __len__(self) -> int:
        return self.ranks[-1] if self.ranks else 0

    def select(self, k: int) -> int:
        """The k-th smallest value, counted from 0."""
        if not 0 <= k < len(self):
            raise IndexError(k)
        at = bisect_left(self.ranks, k + 1)
        return self.keys[at] << 16 | self.containers[at].select(k - (self.ranks[at - 1] if at else 0))


def token_ends(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """For each document of a chunk, 0 and the code points at which its tokens end."""
    words = spans(data, offsets, WORD)
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    ends, out = points[words.ends], []
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        own = ends[words.first[i]:words.first[i + 1]] - points[a]
        size = points[b] - points[a]
        tail = [size] if size and not (len(own) and own[-1] == size) else []
        out.append(np.concatenate([[0], own, tail]).astype(np.int64))
    return out


def digits(seed: int, doc_id: int | None) -> tuple[int, int, int, int]:
    """Four 32-bit numbers of a document."""
    found = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    return int(found[:8], 16), int(found[8:16], 16), int(found[16:24], 16), int(found[24:32], 16)


def transform(text: str, ends: np.ndarray, chosen: tuple[int, int, int, int], rate: int, spm: int):
    """Output, form, and the lengths of prefix and middle (None if plain)."""
    if not text or chosen[2] % 100 >= rate or PREFIX in text or SUFFIX in text or MIDDLE in text:
        return text, "plain", None, None
    bounds = BoundarySet(ends)
    a, b = sorted(bounds.select(h % len(bounds)) for h in chosen[:2])
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if chosen[3] % 100 < spm:
        return f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}", "spm", a, b - a
    return f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}", "psm", a, b - a


def fill_in_middle(docs: DataFrame, *others: str, seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """doc_id, output, n (tokens), form, prefix_chars and middle_chars of each text, and other columns.

    ``rate`` of 100 texts are transformed, ``spm`` of 100 of these begin with the suffix.
    """
    clash = set(others) & {"output", "n", "form", "prefix_chars", "middle_chars"}
    if clash:
        raise ValueError(f"result columns cannot be carried along: {sorted(clash)}")
    prepare(docs.sparkSession)

    def work(batch: pa.RecordBatch) -> list:
        ids, column, rows = batch.column("doc_id").to_pylist(), batch.column("text"), []
        for chunk in chunks(column):
            texts = column.slice(chunk.first, chunk.last - chunk.first).to_pylist()
            for i, (text, ends) in enumerate(zip(texts, token_ends(chunk.data, chunk.offsets))):
                rows.append((transform(text or "", ends, digits(seed, ids[chunk.first + i]), rate, spm), len(ends) - 1))
        made, counts = zip(*rows)
        output, form, prefix, middle = zip(*made)
        return [batch.column("doc_id"), pa.array(output, pa.string()), pa.array(counts, pa.int64()), pa.array(form, pa.string()),
                pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), *(batch.column(c) for c in others)]

    held = documents(docs, *others)
    return by_batch(held, work, extended(_RESULT, held, others))


def restored(output: Column, form: Column) -> Column:
    """The text that was transformed. A mark can lie in no part, nor over the edge of two."""
    parts = F.split(output, "<[PSM]>", -1)
    psm = F.concat(*(F.get(parts, i) for i in (1, 3, 2)))
    spm = F.concat(*(F.get(parts, i) for i in (2, 3, 1)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
