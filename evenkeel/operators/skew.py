"""Joins that stay balanced when one key holds a large share of the rows.

A key is hot when it holds at least ``share`` of the rows, so there can be at
most ``1 / share`` hot keys: the list has a proven bound and may be collected
and broadcast. Hot rows then join map-side against the (unique) other side and
are never shuffled onto one task; all other keys take the ordinary shuffle join.
Finding hot keys only picks the physical plan. Results do not depend on it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

SHARE = 1.0 / 1000
MIN_ROWS = 200_000
BUCKETS = 1 << 12


def hot_keys(df: DataFrame, keys: Sequence[str], share: float = SHARE, min_rows: int = MIN_ROWS) -> DataFrame | None:
    """The keys holding at least ``share`` of the rows and ``min_rows`` of them, or None.

    Exact, without shuffling the keys: rows are first counted by a hash of the key
    in BUCKETS buckets, which tasks combine to a few counts each. A key can only be
    hot in a bucket that is over the limit, so only those buckets are counted by key.
    """
    narrow = df.select(*keys)
    bucket = F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in keys]), F.lit(BUCKETS))
    counts = narrow.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n"))
    # At most BUCKETS entries come back.
    seen = counts.agg(F.sum("n").alias("total"),
                      F.collect_list(F.when(F.col("n") >= min_rows, F.struct("b", "n"))).alias("large")).first()
    limit = max(min_rows, share * (seen["total"] or 0))
    full = [row["b"] for row in seen["large"] if row["n"] >= limit]
    if not full:
        return None
    by_key = narrow.filter(bucket.isin(full)).groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.count(F.lit(1)).alias("__n"))
    rows = by_key.filter(F.col("__n") >= limit).collect()  # at most 1/share keys
    if not rows:
        return None
    kept = [tuple(row[key] for key in keys) for row in rows]
    return df.sparkSession.createDataFrame(kept, narrow.schema)


def lookup_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left",
                hot: DataFrame | None | str = "find", **hot_args) -> DataFrame:
    """Join ``left`` to a ``right`` that is unique on ``keys``, for ``left``, ``inner``,
    ``left_semi`` or ``left_anti``. Keys must have the same names and types on both sides.

    With hot keys on the left, their rows meet a broadcast of at most one right
    row per hot key; the rest is joined by the planner's choice.
    """
    if how not in ("left", "inner", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join kind: {how}")
    keys = list(keys)
    if isinstance(hot, str):
        hot = hot_keys(left, keys, **hot_args)
    if hot is None:
        return left.join(right, keys, how)
    few = F.broadcast(hot)
    known = left.dropna(subset=keys)
    cold_part = known.join(few, keys, "left_anti").join(right, keys, how)
    hot_right = right.join(few, keys, "left_semi")
    hot_part = left.join(few, keys, "left_semi").join(F.broadcast(hot_right), keys, how)
    joined = cold_part.unionByName(hot_part)
    if how in ("left", "left_anti"):
        # Rows with a null key match nothing; they pass by the shuffle.
        any_null = F.greatest(*[F.col(key).isNull() for key in keys], F.lit(False))
        joined = joined.unionByName(left.filter(any_null), allowMissingColumns=True)
    return joined


def join_unique(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join to a ``right`` that is unique on ``keys``.

    The planner broadcasts a small right side by its bytes and splits skewed partitions of
    the left, so nothing is counted beforehand.
    """
    return left.join(right, list(keys), how)
