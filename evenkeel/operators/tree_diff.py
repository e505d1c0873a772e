"""Comparison of large, mostly equal tables by a tree of checksums.

One pass over both tables gives a checksum for each wide range of keys. Only ranges that disagree are read again and split,
level by level, and the rows of the last ranges go to ``row_diff``. Equal rows are neither shuffled nor joined:
each level shuffles a few numbers a range and task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from evenkeel.functions.equality import cell_text, key_text
from evenkeel.operators.diff import NULL_KEY, DiffSpec, _target_names, _types, compared_columns, resolve_keys, row_diff

#: Parts of the whole at the first level and of each range at the next ones; ranges that are split at once; stretches named to a scan.
FIRST, FAN_OUT, MOST_RANGES, STRETCHES = 1024, 64, 1024, 32
_SPAN = 1 << 63


@dataclass(frozen=True)
class Level:
    """What one level read: the width of its ranges, rows of both sides, ranges that disagree and the rows in these."""

    width: int
    rows_read: int
    ranges_differing: int
    rows_differing: int


@dataclass(frozen=True)
class TreeDiff:
    """The rows that differ, as ``row_diff`` gives them without matches, and what was read to find them."""

    diff: DataFrame
    levels: list[Level]


class _Side:
    """One table with the place of each row and the hash of its compared cells."""

    def __init__(self, df: DataFrame, keys: Sequence[str], cells: Sequence[Column], ordered: bool):
        types = _types(df)
        self.df, self.ordered, self.first = df, ordered, F.col(f"`{keys[0]}`")
        if ordered:
            self.place = self.first.cast("long")
        else:
            texts = [F.coalesce(key_text(F.col(f"`{k}`"), types[k]), F.lit(NULL_KEY)) for k in keys]
            self.place = F.shiftrightunsigned(F.xxhash64(*texts), 1)
        # Each cell with its null mark, so that no text reads as a null.
        marked = [part for c in cells for part in (c.isNull(), F.coalesce(c, F.lit("")))]
        self.hash = F.xxhash64(*marked)

    def inside(self, low: int, width: int, ranges: Sequence[int] | None, nulls: bool) -> DataFrame:
        """Rows of the given ranges; with whole-number keys their stretches reach the scan as bounds."""
        if ranges is None:
            return self.df
        number = _div(self.place, low, width)
        tests = []
        if ranges:
            stretches = [F.lit(True)] if not self.ordered else [
                self.place.between(low + a * width, min(low + (b + 1) * width - 1, _SPAN - 1)) for a, b in _stretches(ranges)]
            tests.append(reduce(lambda a, b: a | b, stretches) & number.isin(list(ranges)))
        if nulls:
            tests.append(self.place.isNull())
        return self.df.filter(reduce(lambda a, b: a | b, tests, F.lit(False)))

    def checksums(self, rows: DataFrame, low: int, width: int, side: str) -> DataFrame:
        hashed = rows.select(_div(self.place, low, width).alias("range"), self.hash.alias("h"))
        return hashed.groupBy("range").agg(
            F.count(F.lit(1)).alias("n"), F.bit_xor("h").alias("x"), F.sum(F.col("h").cast("decimal(20,0)")).alias("s")) \
            .withColumn("side", F.lit(side))


def _div(place: Column, low: int, width: int) -> Column:
    """The number of the range that a place lies in, in whole numbers."""
    return F.call_function("div", place - F.lit(low), F.lit(width))


def _stretches(ranges: Sequence[int]) -> list[tuple[int, int]]:
    """The ranges as at most ``STRETCHES`` stretches, joined over the smallest gaps."""
    ranges = sorted(ranges)
    gaps = sorted(range(1, len(ranges)), key=lambda i: ranges[i - 1] - ranges[i])
    cuts = sorted(i for i in gaps[: STRETCHES - 1] if ranges[i] - ranges[i - 1] > 1)
    return [(ranges[a], ranges[b - 1]) for a, b in zip([0, *cuts], [*cuts, len(ranges)])]


def _bounds(sides: Sequence[_Side]) -> tuple[int, int] | None:
    """The least and the greatest place of both sides, or None if there is no row with a place."""
    ends = [side.df.agg(F.min(side.place).alias("lo"), F.max(side.place).alias("hi")).first() for side in sides]
    known = [e for e in ends if e["lo"] is not None]
    return (min(e["lo"] for e in known), max(e["hi"] for e in known)) if known else None


def tree_diff(source: DataFrame, target: DataFrame, spec: DiffSpec) -> TreeDiff:
    """``row_diff`` without matches, for tables that are equal but for a few rows.

    The source must hold each key once (``spec.unique_keys``), as checksums cannot tell which of repeated rows
    is compared. Where the first key is a whole number on both sides, ranges are ranges of that key and their bounds reach the
    scan, so files laid out by key are skipped; other keys are placed by hash, and only the shuffle and join get smaller.
    Null keys are compared as a range of their own, empty tables as any other, and columns that the target lacks read as null.

    Ranges count as equal if rows, exclusive or, and sum of 64-bit row hashes agree. Cells are hashed by their text, which is at least as
    strict as ``row_diff``: cells of other types or case cost reading, and ``row_diff`` decides. Splitting ends at ranges of one place,
    at ``MOST_RANGES`` ranges that disagree, or when these hold more than half of the rows just read; wide
    changes are then simply compared. The driver holds at most ``FAN_OUT * MOST_RANGES`` numbers of ranges.
    """
    if not spec.unique_keys:
        raise ValueError("checksums compare tables whose source holds each key once; say so by unique_keys")
    cols, keys = compared_columns(source, spec.exclude), resolve_keys(spec, source)
    names = list(dict.fromkeys([*keys, *cols]))
    other = _target_names(names, target)
    s_types, t_types = _types(source), _types(target)
    if any(other[k] is None for k in keys):
        return TreeDiff(row_diff(source, target, replace(spec, return_matched=False)), [])
    s_cells = [cell_text(F.col(f"`{c}`"), s_types[c]) for c in names]
    t_cells = [cell_text(F.col(f"`{other[c]}`"), t_types[other[c]]) if other[c] else F.lit(None).cast("string") for c in names]
    whole = all(isinstance(kind, T.IntegralType) for kind in (s_types[keys[0]], t_types[other[keys[0]]]))

    def sides(ordered: bool) -> list[_Side]:
        return [_Side(source, keys, s_cells, ordered), _Side(target, [other[k] for k in keys], t_cells, ordered)]

    pair = sides(whole)
    ends = _bounds(pair) if whole else (0, _SPAN - 1)
    if ends and ends[1] - ends[0] >= _SPAN:  # distances would not fit
        pair, ends = sides(False), (0, _SPAN - 1)
    low, high = ends or (0, 0)

    # Widths of all levels, each a multiple of the next, so that a range is made of whole ranges below it.
    width, above, ranges, nulls, levels = 1, 1, None, True, []
    while width * FIRST <= high - low:
        width *= FAN_OUT
    while True:
        sums = [side.checksums(side.inside(low, above, ranges, nulls), low, width, name) for side, name in zip(pair, "st")]
        both = sums[0].unionByName(sums[1]).groupBy("range").agg(
            F.count(F.lit(1)).alias("sides"), F.sum("n").alias("n"),
            *[F.count_distinct(c).alias(f"{c}_kinds") for c in ("n", "x", "s")])
        same = (F.col("sides") == 2) & (F.col("n_kinds") == 1) & (F.col("x_kinds") == 1) & (F.col("s_kinds") == 1)
        told = both.groupBy(F.when(~same, F.col("range")).alias("range"), same.alias("same")).agg(F.sum("n").alias("n")).collect()
        bad = [r for r in told if not r["same"]]
        ranges, nulls = sorted(r["range"] for r in bad if r["range"] is not None), any(r["range"] is None for r in bad)
        read, differing = sum(r["n"] for r in told), sum(r["n"] for r in bad)
        levels.append(Level(width, read, len(bad), differing))
        above = width
        if width == 1 or len(bad) > MOST_RANGES or not ranges or 2 * differing > read:
            break
        width //= FAN_OUT
    left, right = [side.inside(low, above, ranges, nulls) for side in pair]
    return TreeDiff(row_diff(left, right, replace(spec, return_matched=False)), levels)
