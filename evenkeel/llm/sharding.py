"""Shards of near equal bytes: minimax cuts of an ordered list of atomic groups.

Documents of equal text are one group, which stays whole. Groups are ordered by a digest of
their text, and the list is cut into contiguous shards so that the largest is as small as it
can be: the smallest capacity for which cutting greedily gives few enough shards is found by
binary search. Groups that fill a shard by themselves (at most as many as there are shards)
come first in the order, each in a shard of its own.

The list itself stays in Spark. The driver holds sums over ranges of digests (4096 at first).
A greedy cut that falls into a range is known only to lie there, so each capacity is tried
twice: once as if no range could be cut, once as if all could be cut anywhere. Ranges that the
cuts of some undecided capacity touch are summed anew sixteen times finer, until both trials
agree. At most a few thousand sums are held at a time, however many groups there are.

Cases: a null text is an empty text; null ids are rows like others; rows that repeat are each
placed; an empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import bisect
from itertools import accumulate
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.llm.shared import documents
from evenkeel.session import written

# Fixed values of the layout.
LAW = "bytes"
EXTRA = 16
DIGITS = 3
BUCKETS = 256
BUCKET_ROWS = 20_000


class Range(NamedTuple):
    """All groups whose digest begins with ``prefix``; ``whole`` if it is one group."""

    prefix: str
    size: int
    whole: bool


def greedy_low(sums: list[int], capacity: int, shards: int) -> list[int]:
    """Cuts (numbers of ranges) if no range could be cut: each true cut is here or later."""
    cuts, at = [], 0
    for _ in range(shards):
        at = bisect.bisect_right(sums, sums[at] + capacity) - 1
        cuts.append(at)
    return cuts


def greedy_high(sums: list[int], ranges: list[Range], capacity: int, shards: int) -> list[int]:
    """Cuts (sums) if ranges of many groups could be cut anywhere: each true cut is here or before."""
    cuts, at = [], 0
    for _ in range(shards):
        at = min(at + capacity, sums[-1])
        i = bisect.bisect_right(sums, at) - 1
        if i < len(ranges) and ranges[i].whole:
            at = sums[i]
        cuts.append(at)
    return cuts


def least(lo: int, hi: int, enough) -> int:
    """The smallest capacity from ``lo`` to ``hi`` that is enough; ``hi`` is."""
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if enough(mid) else (mid + 1, hi)
    return lo


def minimax_cuts(ranges: list[Range], shards: int, finer) -> tuple[int, list[str]]:
    """The smallest capacity, and the digest prefixes at which the second and later shards begin.

    ``finer`` gives the ranges within some of the given ones.
    """
    while True:
        sums = [0, *accumulate(r.size for r in ranges)]
        total = sums[-1]
        lo = least(-(-total // shards), total, lambda c: greedy_high(sums, ranges, c, shards)[-1] == total)
        hi = least(lo, total, lambda c: greedy_low(sums, c, shards)[-1] == len(ranges))
        low, high = greedy_low(sums, lo, shards), greedy_high(sums, ranges, hi, shards)
        touched = set()
        for a, value in zip(low, high):
            b = bisect.bisect_right(sums, value) - 1
            touched.update(i for i in range(a, min(b + 1, len(ranges))) if not ranges[i].whole and sums[i] != value)
        if not touched:
            cuts = [c for c in greedy_low(sums, hi, shards) if c < len(ranges)]
            return hi, [ranges[c].prefix for c in cuts]
        parts: dict[str, list[Range]] = {}
        for r in finer([ranges[i].prefix for i in sorted(touched)]):
            parts.setdefault(r.prefix[:-1], []).append(r)
        ranges = [x for i, r in enumerate(ranges) for x in (sorted(parts[r.prefix]) if i in touched else [r])]


def _sums(rows: DataFrame, digits: int, within: list[str] | None = None) -> list[Range]:
    """Sums over ranges of digests; at most 16 for each prefix in ``within``."""
    if within is not None:
        rows = rows.where(F.substring("key", 1, digits - 1).isin(within))
    summed = rows.groupBy(F.substring("key", 1, digits).alias("prefix")).agg(
        F.sum("size").alias("size"), (F.min("key") == F.max("key")).alias("whole"))
    return sorted(Range(*r) for r in summed.collect())


def _finer(rows: DataFrame, prefixes: list[str]) -> list[Range]:
    out = []
    for digits in sorted({len(p) for p in prefixes}):
        out += _sums(rows, digits + 1, [p for p in prefixes if len(p) == digits])
    return out


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (gapless in the shard), grown_shard (null)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = written(documents(docs).select(
        "doc_id", (F.octet_length(text) + F.lit(EXTRA)).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.md5(F.encode(text, "UTF-8")).alias("key")), "sizes")
    total = rows.agg(F.sum("size"), F.count("*")).first()
    large = rows.groupBy("key").agg(F.sum("size").alias("size")).orderBy(F.desc("size"), "key").limit(shards).collect()
    alone, left = [], total[0] or 0
    for row in large:  # those that fill a shard by themselves
        if len(alone) < shards - 1 and row["size"] * (shards - len(alone)) >= left and left > row["size"]:
            alone.append(row["key"])
            left -= row["size"]
    rest = rows.where(~F.col("key").isin(alone)) if alone else rows
    _, begins = minimax_cuts(_sums(rest, DIGITS), shards - len(alone), lambda within: _finer(rest, within))
    shard: Column = F.lit(len(alone))
    for prefix in begins:
        shard = shard + (F.col("key") >= F.lit(prefix)).cast("int")
    for i, key in enumerate(alone):
        shard = F.when(F.col("key") == key, i).otherwise(shard)
    buckets = max(BUCKETS, -(-(total[1] or 0) // BUCKET_ROWS))
    placed = rows.withColumn("shard", shard.cast("int")).withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "key"), F.lit(buckets)).cast("int"))
    sizes = placed.groupBy("shard", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    order = Window.partitionBy("shard", "_bucket").orderBy("doc_id", "key")
    slots = placed.withColumn("_row", F.row_number().over(order)).join(sizes, ["shard", "_bucket"])
    return slots.select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard",
        (F.col("_before") + F.col("_row") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
