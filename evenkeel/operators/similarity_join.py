"""Pairs of values, or of records, that reach a similarity: exact, without scoring all pairs.

Jaro counts matched characters m of two texts and is at most (m/a + m/b + 1) / 3 for lengths a and b,
and m is at most the number of characters that both hold, each as often as in both. So a pair
that reaches a threshold t shares at least ``(3t - 1) * a * b / (a + b)`` characters. Values are dealt
to chunks by length; chunks whose lengths allow that meet in a group of their own, which counts the shared
characters of all its pairs as one product of matrices. Only what passes is scored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from evenkeel.functions.similarity import jaro
from evenkeel.operators.matching import UNSCORED, groups_of, record_score, shown
from evenkeel.session import written

#: Values of one chunk, about, and cells of a table of values by characters.
CHUNK = 2048
CELLS = 8_000_000


def _band(length: Column) -> Column:
    """Lengths that are dealt together: each of its own up to 20, then within a twentieth."""
    return F.floor(F.log(length.cast("double")) / F.lit(math.log(1.05))).cast("int")


def _chunks(values: DataFrame, side: str) -> tuple[DataFrame, DataFrame]:
    """Values with the chunk that they are dealt to, and the chunks with their least and greatest length."""
    rows = values.select("value", F.length("value").alias("length")).withColumn("band", _band(F.col("length")))
    sizes = rows.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("of"), F.min("length").alias("lo"), F.max("length").alias("hi"))
    rows = rows.join(F.broadcast(sizes.select("band", "of")), "band").withColumn("chunk", F.pmod(F.xxhash64("value"), "of").cast("int"))
    each = sizes.select("band", "lo", "hi", F.explode(F.sequence(F.lit(0), F.col("of") - 1)).alias("chunk"))
    return (rows.select("value", *[F.col(c).alias(f"{side}_{c}") for c in ("band", "chunk")]),
            each.select(*[F.col(c).alias(f"{side}_{c}") for c in ("band", "chunk", "lo", "hi")]))


def _held(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and element of each character: its code point and its how-manieth in the text; and the lengths."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    rows = np.repeat(np.arange(len(texts)), lengths)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.int32).astype(np.int64)
    order = np.lexsort((codes, rows))
    rows, codes = rows[order], codes[order]
    places = np.arange(len(codes))
    first = np.ones(len(codes), dtype=bool)
    first[1:] = (codes[1:] != codes[:-1]) | (rows[1:] != rows[:-1])
    return rows, codes << 32 | places - np.maximum.accumulate(np.where(first, places, 0)), lengths


def _sharing(left: list[str], right: list[str], threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places in ``left`` and ``right`` whose texts share enough characters, slice by slice."""
    sides = [_held(left), _held(right)]
    elements, at = np.unique(np.concatenate([s[1] for s in sides]), return_inverse=True)
    numbers = at[:len(sides[0][1])], at[len(sides[0][1]):]
    high = max(1, min(CHUNK, CELLS // len(elements)))

    def table(side: int, top: int) -> np.ndarray:
        rows, _, lengths = sides[side]
        lo, hi = np.searchsorted(rows, (top, top + high))
        out = np.zeros((min(high, len(lengths) - top), len(elements)), dtype=np.float32)
        out[rows[lo:hi] - top, numbers[side][lo:hi]] = 1
        return out

    for first in range(0, len(right), high):
        b, lb = table(1, first).T, sides[1][2][None, first:first + high]
        for top in range(0, len(left), high):
            la = sides[0][2][top:top + high, None]
            least = np.maximum(np.ceil((3 * threshold / 100 - 1) * la * lb / (la + lb) - 1e-6), 1)
            rows, columns = np.nonzero(table(0, top) @ b >= least)
            yield rows + top, columns + first


def candidate_values(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """Pairs ``left``, ``right`` of distinct values (columns ``value``) that can reach the threshold."""
    if threshold <= 100 / 3:
        raise ValueError("a threshold up to 100/3 says nothing about shared characters")
    sides = [df.select(F.col("value").cast("string").alias("value")).where("value <> ''").distinct() for df in (left, right)]
    sides = [written(s, "values") for s in sides]
    (a, a_chunks), (b, b_chunks) = (_chunks(s, mark) for s, mark in zip(sides, ("l", "r")))
    ratio = 3 * threshold / 100 - 2  # the least length against the other's, if above zero
    fits = (F.col("l_hi") >= F.col("r_lo") * ratio - 1e-6) & (F.col("r_hi") >= F.col("l_lo") * ratio - 1e-6)
    key = ["l_band", "l_chunk", "r_band", "r_chunk"]
    pairs = written(a_chunks.crossJoin(F.broadcast(b_chunks)).where(fits).select(*key), "chunks")
    parts = groups_of(pairs.count(), pairs.sparkSession.sparkContext.defaultParallelism)
    met = [df.join(pairs, [f"{m}_band", f"{m}_chunk"]).select(*key, "value").repartition(parts, *key).groupBy(*key) for df, m in ((a, "l"), (b, "r"))]

    def sharing(one: pa.Table, other: pa.Table) -> pa.Table:
        x, y = one.column("value").combine_chunks(), other.column("value").combine_chunks()
        tables = [pa.table({"left": x.take(pa.array(i)), "right": y.take(pa.array(j))})
                  for i, j in (_sharing(x.to_pylist(), y.to_pylist(), threshold) if len(x) and len(y) else ())]
        return pa.concat_tables([pa.table({"left": x.slice(0, 0), "right": y.slice(0, 0)}), *tables])

    return met[0].cogroup(met[1]).applyInArrow(sharing, "left string, right string")


def similar_values(left: DataFrame, right: DataFrame, threshold: float, floor: bool = False) -> DataFrame:
    """``left``, ``right`` and ``score`` of all pairs of distinct values whose Jaro reaches the threshold.

    Null and empty values match nothing, as in ``jaro``; equal values match with 100.
    """
    scored = candidate_values(left, right, threshold).withColumn("score", jaro(F.col("left"), F.col("right"), floor))
    return scored.where(F.col("score") >= threshold)


def _class_pairs(classes: DataFrame, asked: DataFrame, texts: Sequence[str], threshold: float, floor: bool) -> DataFrame:
    """``__class``, ``__asked`` and ``score`` of the pairs of distinct texts of both sides that reach the threshold."""
    side = lambda df, number, mark: df.select(F.col(number).alias(f"{mark}__id"), *[F.col(t).alias(f"{mark}_{t}") for t in texts])
    left, right = side(asked, "__asked", "l"), side(classes, "__class", "r")
    pairs = []
    for t in texts:
        near = similar_values(left.select(F.col(f"l_{t}").alias("value")), right.select(F.col(f"r_{t}").alias("value")), threshold, floor)
        near = near.select(F.col("left").alias(f"l_{t}"), F.col("right").alias(f"r_{t}"))
        pairs.append(near.join(left.select("l__id", f"l_{t}"), f"l_{t}").join(right.select("r__id", f"r_{t}"), f"r_{t}").select("l__id", "r__id"))
    found = reduce(DataFrame.union, pairs).distinct().join(left, "l__id").join(right, "r__id")
    scored = record_score(found, texts, floor=floor).where(F.col("score") >= threshold)
    return scored.select(F.col("r__id").alias("__class"), F.col("l__id").alias("__asked"), "score")


def match_records_joined(records: DataFrame, probes: DataFrame, columns: Sequence[str], threshold: float = 50.0,
                         record_id: str = "id", probe_id: str = "probe_id", floor: bool = False, links: bool = False) -> DataFrame:
    """``record_id``, ``probe_id`` and ``score`` of all pairs that score at least ``threshold``, without blocks.

    A record's score is a mean over columns, so a pair that reaches the threshold reaches it in one column
    at least: candidates are the pairs of similar values of each column, over distinct values. A
    column of few values has as many candidates as rows that share them; name columns that tell records apart.
    Records of equal values are matched once; a pair of classes then stands for all pairs of their members.

    With ``links`` the result has one row per record with ``class_id``, the least ``record_id`` among its equals, and
    ``n_links``, the number of probes that it matches.
    """
    kept = [c for c in columns if c.lower() not in UNSCORED]
    texts = [f"__t{i}" for i in range(len(kept))]
    shown_texts = [shown(c).alias(t) for c, t in zip(kept, texts)]
    marked = records.select("*", *shown_texts) if links else records.select(F.col(f"`{record_id}`").alias("__record"), *shown_texts)
    wanted = probes.select(F.col(f"`{probe_id}`").alias("__probe"), *shown_texts)
    classes = marked.groupBy(*texts).agg(F.min(F.col(f"`{record_id}`")).alias("class_id")) if links else marked.select(*texts).distinct()
    classes = written(classes.withColumn("__class", F.monotonically_increasing_id()), "classes")
    asked = wanted.groupBy(*texts).agg(F.count(F.lit(1)).alias("__n"))
    asked = written(asked.withColumn("__asked", F.monotonically_increasing_id()), "probes")
    found = _class_pairs(classes, asked, texts, threshold, floor)
    if links:
        counted = found.join(asked.select("__asked", "__n"), "__asked").groupBy("__class").agg(F.sum("__n").alias("n_links"))
        counted = classes.join(counted, "__class", "left").select(*texts, "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
        return marked.join(counted, texts).select(*[F.col(f"`{c}`") for c in records.columns], "class_id", "n_links")
    members = marked.join(classes, texts).select("__record", "__class")
    askers = wanted.join(asked, texts).select("__probe", "__asked")
    every = found.join(members, "__class").join(askers, "__asked")
    return every.select(F.col("__record").alias(record_id), F.col("__probe").alias(probe_id), "score")
