"""A mix of sources whose weights change over training, in DataFrame functions alone.

*Targets.* Each source has a schedule of weights over training time 0 to 1, linear between its
knots; its integral is the source's weight in the whole mix. A mix of ``share`` times all words is
dealt out by weight; a target stops at ``repeats`` times the words that its source has, and what is
left over goes to the others by weight, until no target is above.

*Positions.* A source's demand at time t grows with its schedule: the words it has been asked for
up to t are target * W(t) / W(1), with W the integral from 0 to t. Its documents stand in an order
given by a digest, and stand there again once all are used. A document that begins after c words of
that order is due when the demand reaches c, so its position in training is the t with
W(t) / W(1) = c / target: a root of a quadratic in one piece of the schedule. Sorting by position
by ranges gives the training order of all sources at once.

A document is taken whole each time, but for the last one of a source, of which the mix takes the
words that are missing from the target. So the words taken from a source are its target, rounded,
and no document gives more than ``repeats`` times its words (``repeats`` is a whole number).

*Large sources.* Rows are counted in buckets of the digest. Sums of buckets give each bucket its
start, and rows are summed within their (source, bucket) only, so a source of any size is spread
over all tasks. The driver sees two sums for each round of sharing, never a list of sources.

Cases: a null text and a blank text have no words, are taken 0 times and have no position; a null
source is a source of its own, the last one; null doc_ids and rows that repeat are rows like
others, in an order of the digest, id, size and text digest, so reruns agree; long texts count
whole; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.session import written

#: Weights over time as (time, weight) knots, dealt to the sources in turn: falling, rising, level.
#: Their integrals are 3, 1 and 2.
SCHEDULES = (((0, 4), (1, 2)), ((0, 0), (1, 2)), ((0, 2), (1, 2)))
SHARE = Fraction(3, 2)
REPEATS = 2
SEED = 42
BUCKETS, BUCKET_ROWS = 64, 20_000

_WORD = "[^\\x20\\x09-\\x0D]+"


def integral(schedule: Sequence[tuple[float, float]]) -> Fraction:
    """The area under a schedule from 0 to 1."""
    knots = [(Fraction(t), Fraction(w)) for t, w in schedule]
    if knots[0][0] != 0 or knots[-1][0] != 1 or any(a[0] >= b[0] for a, b in zip(knots, knots[1:])) or any(w < 0 for _, w in knots):
        raise ValueError(f"a schedule goes from time 0 to 1 with weights that are not negative: {schedule}")
    return sum(((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:])), Fraction(0))


def time_of(share: Column, schedule: Sequence[tuple[float, float]]) -> Column:
    """The time at which ``share`` (0 to 1) of a schedule's integral has passed."""
    whole, passed = integral(schedule), Fraction(0)
    pieces = []
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]):
        area = share * float(whole) - float(passed)
        slope = (w1 - w0) / (t1 - t0)
        root = F.sqrt(F.greatest(F.lit(float(w0) ** 2) + 2 * slope * area, F.lit(0.0)))
        # The stable form of the quadratic's root; nothing has passed where the denominator is 0.
        step = F.when(root + float(w0) > 0, 2 * area / (root + float(w0))).otherwise(0.0)
        passed += (Fraction(t1) - Fraction(t0)) * (Fraction(w0) + Fraction(w1)) / 2
        pieces.append((float(passed), F.lit(float(t0)) + step))
    out = pieces[-1][1]
    for upto, time in reversed(pieces[:-1]):
        out = F.when(share * float(whole) <= upto, time).otherwise(out)
    return F.least(out, F.lit(1.0))


def ranked_sources(rows: DataFrame) -> DataFrame:
    """_source, source_size and _rank (from 0, by code point, null last): one row per source.

    Ranges of sources are written once, numbered each on its own, and started at the count of the
    ranges before: one row for each range is all that meets in one task.
    """
    sizes = rows.groupBy("_source").agg(F.sum("size").alias("source_size"))
    ranged = written(sizes.repartitionByRange("_source").withColumn("_range", F.spark_partition_id()), "sources")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    local = F.row_number().over(Window.partitionBy("_range").orderBy("_source"))
    return ranged.withColumn("_local", local).join(starts, "_range").select(
        "_source", "source_size", (F.col("_start") + F.col("_local") - 1).alias("_rank"))


def shared_level(sources: DataFrame, share: Fraction, repeats: int) -> Fraction:
    """The words for each unit of weight: targets are the smaller of ``repeats * size`` and this times the weight.

    ``sources`` has ``source_size`` and the whole numbers ``_weight``.
    """
    total = sources.agg(F.sum(F.col("source_size").cast("decimal(38,0)"))).first()[0] or 0
    budget, level = share * int(total), Fraction(0)
    while True:
        above = F.lit(repeats) * F.col("source_size").cast("decimal(19,0)") * level.denominator <= F.col("_weight").cast("decimal(9,0)") * F.lit(level.numerator).cast("decimal(28,0)")
        full, weight = sources.agg(
            F.sum(F.when(above, F.lit(repeats) * F.col("source_size").cast("decimal(19,0)"))),
            F.sum(F.when(~above, F.col("_weight").cast("long")))).first()
        if not weight:
            return level
        higher = (budget - int(full or 0)) / int(weight)
        if higher <= level:
            return level
        level = higher


def mix(docs: DataFrame, schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES, share: Fraction = SHARE,
        repeats: int = REPEATS, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, positions.

    ``positions`` has the time in training of each use of the document, first use first.
    """
    weights = [integral(s) for s in schedules]
    unit = Fraction(1)
    for w in weights:
        unit = Fraction(1, (unit / w.denominator).denominator)
    whole = [int(w / unit) for w in weights]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("t"))  # null last
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null "), F.xxhash64(text)))))
    rows = written(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.regexp_count(text, F.lit(_WORD)).cast("long").alias("size"),
        key.alias("_source"), digest.alias("_digest"), F.xxhash64(text).alias("_text")), "sizes")
    # Digests are cut at equal steps, so buckets of a source follow each other in its order.
    buckets = max(BUCKETS, -(-rows.count() // BUCKET_ROWS))
    place = F.conv(F.substring("_digest", 1, 8), 16, 10).cast("long")
    rows = rows.withColumn("_bucket", F.floor(place * F.lit(buckets) / F.lit(1 << 32)).cast("int"))

    weight = F.element_at(F.array(*[F.lit(w) for w in whole]), (F.col("_rank") % len(whole) + 1).cast("int"))
    sources = written(ranked_sources(rows).withColumn("_weight", weight), "weights")
    level = shared_level(sources, share, repeats)
    most = (F.lit(repeats) * F.col("source_size")).cast("double")
    by_weight = F.col("_weight") * F.lit(float(level.numerator)) / F.lit(float(level.denominator))
    sources = sources.withColumn("target", F.least(most, by_weight))

    sums = rows.groupBy("_source", "_bucket").agg(F.sum("size").alias("_size"))
    before = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("_start", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size").join(sources, "_source")
    order = Window.partitionBy("_source", "_bucket").orderBy("_digest", "doc_id", "size", "_text").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_within", F.coalesce(F.sum("size").over(order), F.lit(0))).join(starts, ["_source", "_bucket"])

    asked, begin = F.round("target").cast("long"), F.col("_start") + F.col("_within")
    uses = F.transform(F.sequence(F.lit(0), F.lit(repeats - 1)), lambda e: begin + e * F.col("source_size"))
    used = F.filter(uses, lambda c: (c < asked) & (F.col("size") > 0))
    taken = F.aggregate(used, F.lit(0).cast("long"), lambda n, c: n + F.least(F.col("size"), asked - c))
    due = F.transform(used, lambda c: _time(c / F.col("target"), F.col("_rank"), schedules))
    return placed.select(
        "doc_id", F.when(F.col("_source") != "t", F.expr("substring(_source, 2)")).alias("source"), "size", "source_size",
        "target", taken.alias("taken"), due.alias("positions"))


def _time(share: Column, rank: Column, schedules: Sequence[Sequence[tuple[float, float]]]) -> Column:
    out = time_of(share, schedules[-1])
    for i, schedule in enumerate(schedules[:-1]):
        out = F.when(rank % len(schedules) == i, time_of(share, schedule)).otherwise(out)
    return out


def training_order(mixed: DataFrame) -> DataFrame:
    """doc_id, use (from 0) and position of every use of every document, range-sorted by position."""
    return mixed.select("doc_id", F.posexplode("positions").alias("use", "position")).orderBy("position", "doc_id", "use")
