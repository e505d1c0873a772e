"""Reading only what is new, long-text splitting and delayed retries."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from evenkeel.functions.equality import BLANKS
from evenkeel.session import small_batches

# Rows per read in the watched service, text length per part, least distance of a soft cut, retry delay and rounds.
CYCLE_CAP = 100
PART_LENGTH = 4000
LEAST_PART = 500
RETRY_SECONDS = 60
RETRY_ROUNDS = 3
PART_NUMBERING = "\n\n<i>[Bagian %d/%d]</i>"


def parse_mark(text: str | None):
    """A stored mark: a whole number where it is one, else text; none is 0."""
    clean = (text or "").strip()
    if not clean:
        return 0
    try:
        return int(clean)
    except ValueError:
        return clean


def high_water_read(df: DataFrame, column: str, mark=None, key: Sequence[str] = (), cap: int | None = None,
                    manual: bool = False) -> tuple[DataFrame, DataFrame]:
    """New rows above a mark, and a one-row frame ``mark`` (plus the keys) to store.

    Without a mark, unless ``manual``, the first read only takes the highest value
    and gives no rows. ``mark`` is a value of ``column``; with ``key`` columns, whose
    values with ``column`` name one row, it is the full tuple ``(value, *key values)``.

    ``cap`` bounds the rows of one read, and no row is lost to it: with keys the rest of
    a run of equal values is read next time; without them a read goes on to the end of
    the run it has begun, and so may be longer than the cap.
    """
    order = [column, *key]
    if mark is not None and key and not (isinstance(mark, tuple) and len(mark) == len(order)):
        raise ValueError(f"with keys the mark is a tuple of {len(order)} values")
    marks = [F.col(c).alias(n) for c, n in zip(order, ["mark", *key])]
    if mark is None and not manual:
        top = df.select(*marks).filter(F.col("mark").isNotNull()).orderBy(*[F.desc(n) for n in ["mark", *key]]).limit(1)
        return df.limit(0), top
    rows = df.filter(F.col(column).isNotNull())
    if mark is not None:
        values = mark if isinstance(mark, tuple) else (mark,)
        first = F.lit(values[0])
        # The plain bound on the first column reaches the scan; the tie test runs on what is left.
        rows = rows.filter(F.col(column) >= first if len(values) > 1 else F.col(column) > first)
        if len(values) > 1:
            rows = rows.filter(F.struct(*order[: len(values)]) > F.struct(
                *[F.lit(v).cast(df.schema[c].dataType).alias(c) for v, c in zip(values, order)]))
    if cap is not None and key:
        rows = rows.orderBy(*order).limit(cap)
    elif cap is not None:
        highest = rows.select(F.col(column).alias("v")).orderBy("v").limit(cap).agg(F.max("v")).first()[0]
        rows = rows.filter(F.col(column) <= F.lit(highest))
    last = rows.select(*marks).orderBy(*[F.desc(n) for n in ["mark", *key]]).limit(1)
    return rows, last


def _parts(text: str | None, longest: int) -> list[str]:
    """Cut at the last line end in reach, else the last space, else at the length."""
    if text is None or len(text) <= longest:
        return [text or ""]
    parts, rest = [], text
    while rest:
        cut = longest
        if len(rest) > longest:
            for mark in ("\n", " "):
                at = rest.rfind(mark, 0, longest + 1)
                if at > LEAST_PART:
                    cut = at
                    break
        parts.append(rest[:cut].strip(BLANKS))
        rest = rest[cut:].lstrip("\n ")
    return parts


def split_long_text(df: DataFrame, column: str, max_len: int = PART_LENGTH,
                    numbering: str = PART_NUMBERING) -> DataFrame:
    """One row per part of a long text, with ``part``, ``parts`` and ``part_text``.

    Parts of a cut text end with their number. Texts up to ``max_len`` stay whole. Texts visit Python in
    small batches, so that a worker's memory does not grow with the rows.
    """
    small_batches(df.sparkSession)

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _parts(t, max_len))

    # Only long texts visit Python.
    value = F.col(f"`{column}`")
    pieces = F.coalesce(cut(F.when(F.length(value) > max_len, value)), F.array(F.lit("")))
    out = df.withColumn("__parts", F.when(F.length(value) > max_len, pieces)
                        .otherwise(F.array(F.coalesce(value, F.lit("")))))
    out = out.select(*[F.col(f"`{c}`") for c in df.columns], F.size("__parts").alias("parts"),
                     F.posexplode("__parts").alias("part", "part_text"))
    numbered = F.concat("part_text", F.format_string(numbering, F.col("part") + 1, F.col("parts")))
    return out.withColumns({"part": F.col("part") + 1,
                            "part_text": F.when(F.col("parts") > 1, numbered).otherwise(F.col("part_text"))})


def schedule_retry(tasks: DataFrame, failed_at: Column, seconds: int = RETRY_SECONDS) -> DataFrame:
    """After a failure: one more round, due again after the delay."""
    return tasks.withColumns({"round": F.col("round") + 1,
                              "retry_at": failed_at + F.make_interval(secs=F.lit(seconds))})


def retry_due(tasks: DataFrame, now: Column, rounds: int = RETRY_ROUNDS) -> DataFrame:
    """Waiting tasks whose time has come and that have rounds left."""
    return tasks.filter((F.col("retry_at") <= now) & (F.col("round") < rounds))


def retries_spent(tasks: DataFrame, rounds: int = RETRY_ROUNDS) -> DataFrame:
    """Tasks out of rounds; they belong to the dead letters."""
    return tasks.filter(F.col("round") >= rounds)
