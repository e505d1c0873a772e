"""Packing documents into sequences: length patterns fitted by non-negative least squares.

1. Documents become pieces of at most ``capacity`` tokens; only longer documents are cut.
2. The histogram of piece lengths (at most ``capacity`` numbers) is all that the driver sees.
   Patterns of one to four lengths that fill a sequence exactly are enumerated, and repeat
   counts ``x >= 0`` are fitted so that the patterns' lengths add up to the histogram.
3. Counts are rounded and applied as far as the histogram allows, the best filled first. What
   is left is packed best fit, longest first, over runs of equal lengths.
4. Pieces get their place from their rank among pieces of the same length. Ranks are counted
   in buckets of rows, so a length that very many documents share is not gathered in one task.

Cases: null and empty texts are documents of the end id alone; rows that repeat a document are
packed each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from evenkeel.llm.shared import by_batch, documents, prepare
from evenkeel.llm.tokens import encoder, groups
from evenkeel.session import written

#: For each longest length of a pattern, so many partners are tried at each further place.
PARTNERS = 12
ROUNDS = 400
#: Rows of one length in one bucket, about.
BUCKET_ROWS = 50_000
BUCKETS = 64

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Tokenize documents and cut those of more than ``capacity`` ids: one row for each piece."""
    prepare(docs.sparkSession)

    def cut(batch: pa.RecordBatch) -> list:
        encode, rows = encoder(tokenizer), []
        ids = batch.column(0).to_pylist()
        end = np.array([end_id], "<u4")
        for first, texts in groups(batch.column(1).to_pylist()):
            for i, tokens in enumerate(encode.encode(texts), first):
                whole = np.concatenate([tokens.astype("<u4"), end])
                for k, start in enumerate(range(0, len(whole), capacity)):
                    held = whole[start:start + capacity]
                    rows.append((ids[i], k, start, len(held), zlib.crc32(held.tobytes())))
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return [pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)]

    return by_batch(documents(docs), cut, PIECES)


def patterns(counts: np.ndarray) -> list[tuple[int, ...]]:
    """Combinations of one to four lengths that fill a sequence; ``counts[n]`` pieces have length n."""
    capacity = len(counts) - 1
    present = np.flatnonzero(counts)
    present = present[present > 0]
    found = {(int(n),) for n in present if n == capacity}
    plenty = present[np.argsort(-counts[present], kind="stable")]

    def partners(most: int, least: int) -> np.ndarray:
        fit = plenty[(plenty <= most) & (plenty >= least)]
        return fit[np.linspace(0, len(fit) - 1, min(PARTNERS, len(fit))).astype(int)] if len(fit) else fit

    for a in map(int, present):
        rest = capacity - a
        if 0 < rest <= a and counts[rest]:
            found.add((a, rest))
        for b in map(int, partners(min(a, rest - 1), 1)):
            c = rest - b
            if 0 < c <= b and counts[c]:
                found.add((a, b, c))
            for c in map(int, partners(min(b, rest - b - 1), 1)):
                d = rest - b - c
                if 0 < d <= c and counts[d]:
                    found.add((a, b, c, d))
    return sorted(found, reverse=True)


def fit(counts: np.ndarray, chosen: list[tuple[int, ...]]) -> np.ndarray:
    """Non-negative least squares ``min |A x - counts|`` by accelerated projected gradients."""
    if not chosen:
        return np.zeros(0)
    rows = np.concatenate([np.array(p) for p in chosen])
    cols = np.repeat(np.arange(len(chosen)), [len(p) for p in chosen])
    n = len(chosen)
    forward = lambda x: np.bincount(rows, x[cols], len(counts))
    back = lambda r: np.bincount(cols, r[rows], n)
    v = np.ones(n)
    for _ in range(30):  # the largest eigenvalue of A'A, for the step
        v = back(forward(v))
        size = np.linalg.norm(v)
        v /= size
    step, x = 1 / (size * 1.05), np.zeros(n)
    y, t = x, 1.0
    for _ in range(ROUNDS):
        new = np.maximum(0, y - step * back(forward(y) - counts))
        following = (1 + np.sqrt(1 + 4 * t * t)) / 2
        x, y, t = new, new + (t - 1) / following * (new - x), following
    return x


def best_fit(counts: np.ndarray) -> list[tuple[list[tuple[int, int]], int]]:
    """Best fit, longest first, over runs of equal lengths: (pattern of (length, times), repeats).

    The same sequences as placing pieces one by one: equal pieces go on filling the sequence
    with the least room that fits before the next one is touched.
    """
    capacity = len(counts) - 1
    open_: dict[int, list[tuple[list[tuple[int, int]], int]]] = {capacity: []}
    for length in np.flatnonzero(counts)[::-1]:
        length, left = int(length), int(counts[length])
        while left and length:
            room = min((r for r, held in open_.items() if r >= length and held), default=capacity)
            pattern, n = open_[room].pop() if open_.get(room) else ([], left)
            times = room // length
            full = min(n, left // times)
            if full:
                open_.setdefault(room - times * length, []).append((pattern + [(length, times)], full))
                left, n = left - full * times, n - full
            if left and n:  # fewer pieces than one sequence takes
                open_.setdefault(room - left * length, []).append((pattern + [(length, left)], 1))
                left, n = 0, n - 1
            if n and pattern:
                open_.setdefault(room, []).append((pattern, n))
    return [x for held in open_.values() for x in held if x[0]]


def plan(counts: np.ndarray) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns with their repeats that use each piece of the histogram exactly once."""
    left = counts.astype(np.int64).copy()
    left[0] = 0
    chosen = patterns(left)
    repeats = fit(left.astype(float), chosen)
    out = []
    for k in np.argsort(-repeats, kind="stable"):
        lengths, times = np.unique(np.array(chosen[k]), return_counts=True)
        n = int(min(round(repeats[k]), (left[lengths] // times).min()))
        if n > 0:
            left[lengths] -= n * times
            out.append(([(int(a), int(b)) for a, b in zip(lengths[::-1], times[::-1])], n))
    return out + best_fit(left)


def pack(cut: DataFrame, capacity: int = 2048, keys: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """Give each row a sequence and an offset by its ``length``: columns ``sequence_id`` and ``offset``."""
    counts = np.zeros(capacity + 1, np.int64)
    for row in cut.groupBy("length").agg(F.count("*").alias("n")).collect():  # at most ``capacity`` rows
        counts[row["length"]] = row["n"]
    slots, base = [], 0
    ranked_to = np.zeros(capacity + 1, np.int64)
    for pattern, n in plan(counts):
        offset = 0
        for length, times in pattern:
            slots.append((length, ranked_to[length], times, base, offset))
            ranked_to[length] += n * times
            offset += length * times
        base += n
    table = np.array(sorted(slots), np.int64).reshape(-1, 5)
    starts = table[:, 0] << 44 | table[:, 1]
    buckets = max(BUCKETS, -(-int(counts.max()) // BUCKET_ROWS))
    hashed = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    bucketed = cut.withColumn("_bucket", hashed)
    sizes = bucketed.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    order = Window.partitionBy("length", "_bucket").orderBy(*keys)
    ranked = bucketed.withColumn("_row", F.row_number().over(order)).join(sizes, ["length", "_bucket"])
    ranked = ranked.withColumn("_rank", F.col("_before") + F.col("_row") - 1).drop("_bucket", "_before", "_row")
    kept = cut.columns

    def place(batch: pa.RecordBatch) -> list:
        lengths = np.asarray(batch.column("length"))
        ranks = np.asarray(batch.column("_rank"))
        at = np.searchsorted(starts, lengths << 44 | ranks, "right") - 1
        run = ranks - table[at, 1]
        times = table[at, 2]
        return [batch.column(c) for c in kept] + [pa.array(table[at, 3] + run // times), pa.array(table[at, 4] + run % times * lengths)]

    schema = StructType([*cut.schema.fields, *StructType.fromDDL("sequence_id long, offset long").fields])
    return by_batch(ranked.select(*kept, "_rank"), place, schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Tokenize, cut and pack: one row for each piece with its sequence and offset.

    The pieces (a few numbers each) are written once to the shared folder, as they are read for
    the histogram, the ranks and the result.
    """
    return pack(written(pieces(docs, tokenizer, capacity, end_id), "pieces"), capacity)
