"""Row numbers and pages that do not put a large group into one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from evenkeel.operators.diff import DiffSpec, _orderable, resolve_keys
from evenkeel.operators.skew import hot_keys
from evenkeel.session import written
from evenkeel.sources import snapshots


def _by_ranges(df: DataFrame, group: Sequence[str], order: Sequence[Column], out: str,
               partitions: int | None = None) -> DataFrame:
    """Row numbers for groups of any size.

    Rows are range-partitioned on (group, order) and written down, so that every
    later step sees the same ranges, also after an executor is lost. Each range is
    numbered on its own; the few (group, range) counts give the start of each.
    """
    keys = [F.col(f"`{g}`") for g in group]
    spread = [partitions] if partitions else []
    ranged = written(df.repartitionByRange(*spread, *[k.asc_nulls_first() for k in keys], *order)
                     .withColumn("__range", F.spark_partition_id()), "ranges")
    piece = Window.partitionBy(*keys, "__range").orderBy(*order)
    local = ranged.withColumn("__local", F.row_number().over(piece))
    sizes = ranged.groupBy(*keys, "__range").agg(F.count(F.lit(1)).alias("__n"))
    # One row per (group, range): a group has at most one row per partition here.
    earlier = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        *[k.alias(f"__g{i}") for i, k in enumerate(keys)], F.col("__range").alias("__r"),
        F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__start"))
    cond = reduce(lambda a, b: a & b,
                  [local[g].eqNullSafe(starts[f"__g{i}"]) for i, g in enumerate(group)],
                  F.col("__range") == F.col("__r"))
    return local.join(starts, cond, "left").select(
        *[F.col(f"`{c}`") for c in df.columns], (F.col("__start") + F.col("__local")).cast("long").alias(out))


def bounded_ranges(df: DataFrame, order: Sequence[str], bounds: int | None = None) -> DataFrame:
    """``df`` with ``__range``, the number of its range in the order of ``order`` (nulls first), by an expression alone.

    The order columns are hashed into ``bounds`` classes (four a shuffle partition, 1024 at least), and the row with the least hash
    of each class is a bound. So bounds are the same each time, nothing has to be written to freeze them, no row is shuffled
    for them (a task sends one number a class), copies of a row count once, and they travel as one row of that
    proven size. A row finds its range by halving steps. Rows equal in all of ``order`` share a range.
    """
    bounds = bounds or max(1024, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    place = F.struct(*[F.col(f"`{o}`").alias(f"o{i}") for i, o in enumerate(order)])
    hashed = F.xxhash64(*[F.col(f"`{o}`") for o in order])
    least = df.select(hashed.alias("h")).groupBy(F.pmod("h", F.lit(bounds)).alias("c")).agg(F.min("h").alias("h")).select("h")
    some = df.select(place.alias("b"), hashed.alias("h")).join(F.broadcast(least), "h", "left_semi").groupBy("h").agg(F.min("b").alias("b"))
    all_bounds = some.agg(F.array_sort(F.collect_list("b")).alias("__bounds"))
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(bounds.bit_length()))])

    def halve(found: Column, step: Column) -> Column:
        further = found + step
        inside = F.when(further <= F.size("__bounds"), F.element_at("__bounds", further) <= F.col("__place")).otherwise(F.lit(False))
        return F.when(inside, further).otherwise(found)

    return df.withColumn("__place", place).crossJoin(F.broadcast(all_bounds)) \
        .withColumn("__range", F.aggregate(steps, F.lit(0), halve)).drop("__place", "__bounds")


def rank_rows(df: DataFrame, group: Sequence[str], order: Sequence[str | Column], out: str = "rank",
              **hot_args) -> DataFrame:
    """Number the rows of each group from 1 in the given total order.

    Groups of ordinary size use a plain window. Groups holding a large share of
    the rows, or all rows when there is no group, are numbered over ranges.
    """
    cols = [F.col(f"`{o}`").asc_nulls_first() if isinstance(o, str) else o for o in order]
    if not group:
        return _by_ranges(df, group, cols, out)
    window = Window.partitionBy(*[F.col(f"`{g}`") for g in group]).orderBy(*cols)

    def plain(part: DataFrame) -> DataFrame:
        return part.withColumn(out, F.row_number().over(window).cast("long"))

    hot = hot_keys(df, group, **hot_args)
    if hot is None:
        return plain(df)
    few = F.broadcast(hot.select(*[F.col(g).alias(f"__h{i}") for i, g in enumerate(group)]))
    same = reduce(lambda a, b: a & b, [df[g].eqNullSafe(few[f"__h{i}"]) for i, g in enumerate(group)])
    return plain(df.join(few, same, "left_anti")).unionByName(
        _by_ranges(df.join(few, same, "left_semi"), group, cols, out))


def with_row_number(df: DataFrame, order: Sequence[str | Column], out: str = "__rn__") -> DataFrame:
    """Number all rows in the given total order."""
    return rank_rows(df, (), order, out)


def ordered(df: DataFrame, spec: DiffSpec) -> DataFrame:
    """Sort columns first, then the keys as tie break; nulls first."""
    names = list(dict.fromkeys([*spec.sort, *resolve_keys(spec, df)]))
    return df.orderBy(*[F.col(f"`{n}`").asc_nulls_first() for n in names])


def page_info(df: DataFrame, size: int) -> DataFrame:
    """Total rows and pages."""
    total = F.count(F.lit(1))
    return df.agg(total.alias("total"), F.ceil(total / size).cast("long").alias("pages"))


def tie_free(df: DataFrame, order: Sequence[str]) -> list[Column]:
    """``order``, then all other columns that have an order: rows that still tie are equal in all of these."""
    rest = [f.name for f in df.schema.fields if f.name not in order and not isinstance(f.dataType, (T.MapType, T.VariantType))]
    return [F.col(f"`{c}`").asc_nulls_first() for c in (*order, *rest)]


class PageIndex:
    """Pages of a table in a total order: its rows once with their numbers, in ranges of that order.

    The numbers are stored beside the rows, so a page of any depth is a range of numbers: the scan skips
    all row groups whose bounds lie outside, nothing is sorted or counted again, and no page
    shares a row with another one, also where the order's columns tie.
    """

    def __init__(self, df: DataFrame, order: Sequence[str], size: int = 2000):
        self.size = size
        self.rows = written(rank_rows(df, (), tie_free(df, order), "__page_row"), "pages")

    def info(self) -> DataFrame:
        """Total rows and pages."""
        return page_info(self.rows, self.size)

    def page(self, number: int = 1) -> DataFrame:
        """One page; numbers below 1 read as 1."""
        start = (max(number, 1) - 1) * self.size
        return self.rows.filter(F.col("__page_row").between(start + 1, start + self.size)).drop("__page_row")

    def numbered(self) -> DataFrame:
        """All rows with the number of their page, as ``page``."""
        return self.rows.withColumn("page", F.ceil(F.col("__page_row") / self.size).cast("long")).drop("__page_row")


def paged(df: DataFrame, order: Sequence[str], page: int = 1, size: int = 2000) -> DataFrame:
    """One page of the rows in ``order``, ties by all other columns; pages below 1 read as 1.

    For more than one page make a ``PageIndex`` and keep it.
    """
    return PageIndex(df, order, size).page(page)


def tail_log(messages: DataFrame, n: int = 10, partition: str = "partition", offset: str = "offset") -> DataFrame:
    """The last ``n`` messages of each partition. Each task keeps only its own top ``n``
    before the shuffle, so a large partition stays cheap."""
    newest = Window.partitionBy(partition).orderBy(F.desc(offset))
    return messages.withColumn("__rank", F.row_number().over(newest)).filter(F.col("__rank") <= n).drop("__rank")


# Reset kinds and the part of the date that starts a new count.
RESET_PERIODS = {"DAILY": "day", "MONTHLY": "month", "YEARLY": "year"}


class _Sequences:
    """What a sequence's definition says about its rows, as columns that differ by sequence."""

    def __init__(self, definitions: Sequence[Mapping], key: str, ts: str):
        self.definitions, self.key, self.ts = definitions, key, ts

    def _per_key(self, value) -> Column:
        branches = None
        for d in self.definitions:
            test = F.col(self.key) == d["seq_key"]
            result = value(d)
            branches = F.when(test, result) if branches is None else branches.when(test, result)
        return branches

    def known(self) -> Column:
        return F.coalesce(F.col(self.key).isin([d["seq_key"] for d in self.definitions]), F.lit(False))

    @staticmethod
    def _period_of(d, col: Column) -> Column:
        unit = RESET_PERIODS.get(str(d.get("reset_type", "")).upper())
        return F.to_date(F.date_trunc(unit, col)) if unit else F.lit("1970-01-01").cast("date")

    def period(self) -> Column:
        return self._per_key(lambda d: self._period_of(d, F.col(self.ts)))

    def carried(self, period: str) -> Column:
        """The number that a period without numbers of its own goes on from."""
        def start_of(d) -> Column:
            start, last = int(d.get("current_value") or 0), d.get("last_reset_date")
            if str(d.get("reset_type", "")).upper() not in RESET_PERIODS:
                return F.lit(start).cast("long")
            if last is None:
                return F.lit(0).cast("long")
            same = self._period_of(d, F.lit(str(last)).cast("date")) == F.col(period)
            return F.when(same, F.lit(start)).otherwise(F.lit(0)).cast("long")

        return self._per_key(start_of)

    def formatted(self) -> Column:
        def text_of(d) -> Column:
            sep = d.get("date_separator") or ""
            width = int(d.get("pad_length") or 0)
            digits = F.col("number").cast("string")
            text = F.when(F.length(digits) >= width, digits).otherwise(F.lpad(digits, max(width, 1), "0"))
            prefix, suffix, fmt = d.get("prefix") or "", d.get("suffix") or "", d.get("date_format") or ""
            if prefix.strip():
                dated = [F.lit(sep), F.date_format(F.col(self.ts), fmt)] if fmt.strip() else []
                text = F.concat(F.lit(prefix), *dated, F.lit(sep), text)
            return F.concat(text, F.lit(sep + suffix)) if suffix.strip() else text

        return self._per_key(text_of)


def document_numbers(rows: DataFrame, definitions: Sequence[Mapping], key: str, ts: str, order: Sequence[str],
                     **hot_args) -> DataFrame:
    """Running document numbers per sequence, restarting per day, month or year.

    A definition has ``seq_key, prefix, suffix, date_format, date_separator,
    pad_length, reset_type, current_value, last_reset_date``. The first period
    carries on from ``current_value`` if ``last_reset_date`` lies in it (or the
    sequence never resets). Rows of unknown sequences get no number.
    Adds ``number`` and ``formatted``. For batches that go on from each other see ``DocumentCounters``.
    """
    told = _Sequences(definitions, key, ts)
    numbered = rank_rows(rows.filter(told.known()).withColumn("__period", told.period()), [key, "__period"], [ts, *order],
                         "number", **hot_args)
    numbered = numbered.withColumn("number", F.col("number") + told.carried("__period"))
    out = numbered.withColumn("formatted", told.formatted()).drop("__period")
    return out.unionByName(rows.filter(~told.known()), allowMissingColumns=True)


class DocumentCounters:
    """Document numbers over many batches: each goes on where the last one ended, without gap or repeat.

    ``path`` holds a small table of counters, one row for each period of a sequence: ``start``, the last number before
    the batch, and ``last``, the last one after it. A batch writes it anew and swaps the pointer in one step before any of its rows
    has a number, so a batch that is repeated after a failure gets the same numbers, also when later ones were made
    since. One writer at a time. A repeated batch must bring the same rows, as a stream's batches do.
    """

    def __init__(self, spark: SparkSession, path: str, definitions: Sequence[Mapping]):
        self.spark, self.path, self.definitions = spark, path, definitions

    def counters(self) -> DataFrame | None:
        """``seq_key, period, start, last`` after the last batch; None before the first."""
        folder = snapshots.current_folder(self.spark, self.path)
        return None if folder is None else self.spark.read.parquet(folder)

    def number(self, rows: DataFrame, batch: int, key: str, ts: str, order: Sequence[str]) -> DataFrame:
        """``document_numbers`` of one batch; ties of ``ts`` and ``order`` go by all other columns.

        A late row of an earlier period gets that period's next number. Rows without a time are a period
        of their own in sequences that restart. Rows of unknown sequences and of none get no number; an empty batch changes nothing.
        Rows are numbered within ranges of the total order, so a sequence may hold any share of them: they are read four times
        (twice for bounds, counts, numbers), shuffled for the last, and never written. Only rows equal in every column cannot be split.
        """
        taken = {"number", "formatted", "__seq", "__day", "__period", "__range", "__place", "__bounds"} & set(rows.columns)
        if taken:
            raise ValueError(f"columns of these names are made here: {sorted(taken)}")
        told = _Sequences(self.definitions, key, ts)
        known = rows.filter(told.known()).withColumns({
            "__seq": F.col(f"`{key}`").cast("string"), "__day": told.period()})
        known = known.withColumn("__period", F.coalesce(F.col("__day").cast("string"), F.lit("undated")))
        total = list(dict.fromkeys([ts, *order]))
        rest = [f.name for f in rows.schema.fields if f.name not in total and _orderable(f.dataType)]
        total += rest
        group = ["__seq", "__period"]
        ranged = bounded_ranges(known, [*group, *total])
        sizes = ranged.groupBy(*group, "__range").agg(F.count(F.lit(1)).alias("__n"), F.first("__day").alias("__day"))
        self._advance(sizes, told, batch, key)
        starts = self.spark.read.parquet(f"{self.path}/{self._version(batch)}").select(
            F.col("seq_key").alias("__seq"), F.col("period").alias("__period"), F.col("start").alias("__start"))
        earlier = Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
        before = sizes.join(starts, group).select(
            *group, "__range", (F.col("__start") + F.coalesce(F.sum("__n").over(earlier), F.lit(0))).alias("__before"))
        piece = Window.partitionBy(*group, "__range").orderBy(*[F.col(f"`{c}`").asc_nulls_first() for c in total])
        out = ranged.withColumn("__local", F.row_number().over(piece)).join(before, [*group, "__range"]) \
            .withColumn("number", (F.col("__before") + F.col("__local")).cast("long")).withColumn("formatted", told.formatted())
        names = [F.col(f"`{c}`") for c in rows.columns]
        return out.select(*names, "number", "formatted").unionByName(rows.filter(~told.known()), allowMissingColumns=True)

    def expire(self, keep: int = 100) -> None:
        """Remove the counters of all batches but the last ``keep``; those before can then not be repeated."""
        batches = sorted(int(name.split("=")[1]) for name in snapshots.folders(self.spark, self.path, "batch="))
        for batch in batches[:-max(keep, 1)]:
            snapshots.remove(self.spark, f"{self.path}/{self._version(batch)}")

    @staticmethod
    def _version(batch: int) -> str:
        return f"batch={batch}"

    def _advance(self, sizes: DataFrame, told: _Sequences, batch: int, key: str) -> None:
        """Write and publish the counters after this batch, unless that was done before."""
        version, current = self._version(batch), snapshots.current_version(self.spark, self.path)
        last = int(current.split("=")[1]) if current else None
        if last is not None and batch <= last:
            # The folder of a batch that was published stays, and a batch is never written after a later one.
            if not snapshots.exists(self.spark, f"{self.path}/{version}"):
                raise ValueError(f"batch {batch} has no counters, and batch {last} was numbered")
            return
        added = sizes.groupBy(F.col("__seq").alias("seq_key"), F.col("__period").alias("period")).agg(
            F.sum("__n").alias("__added"), F.first("__day").alias("__day")) \
            .withColumn(key, F.col("seq_key")).withColumn("__carried", told.carried("__day")) \
            .select("seq_key", "period", "__added", "__carried")
        held = self.counters()
        if held is None:
            held = added.limit(0).select("seq_key", "period", F.lit(0).cast("long").alias("last"))
        fresh = held.select("seq_key", "period", "last").join(added, ["seq_key", "period"], "full_outer").withColumn(
            "start", F.coalesce("last", "__carried", F.lit(0)).cast("long"))
        snapshots.write_snapshot(fresh.select(
            "seq_key", "period", "start", (F.col("start") + F.coalesce("__added", F.lit(0))).cast("long").alias("last")), self.path, version)
