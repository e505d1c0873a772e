"""A warehouse table refreshed from state that is stored by buckets of keys.

``warehouse.join_refresh`` reads the landing rows of all tables for every batch. Here each table,
the target, and for each link between two tables an index from the parent's key to the child's,
are folders by ``pmod(xxhash64(key), buckets)``, and in those one folder per batch. A batch then
reads the buckets that it touches and no others: their numbers (at most ``buckets``) are known
before a read is planned, and only their folders are listed.

A refresh has three parts:

1. *Store* the batch: its rows, and for each link the pairs (parent key, child key) of its rows.
2. *Mark.* From the tables far from the driving one to the driving one, changed keys are turned
   into the keys of rows that ever pointed at them, hop by hop through the indexes.
3. *Recompute.* The marked driving rows are read from their buckets, then what they point at, hop by
   hop outwards; the query runs on these views. Marked keys that no longer come out are deletes.

The target's current view then equals the query over the current views. Repeating a batch rewrites
its own folders. ``compact_buckets`` reduces buckets of many folders, as a job of its own.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from evenkeel.operators.versioned import current_view, latest_version
from evenkeel.sources import snapshots

TARGET = "target"
_BUCKET, _BATCH, _SCHEMA = "state_bucket", "state_batch", "_schema.json"


@dataclass(frozen=True)
class Link:
    """Rows of ``child`` point with ``columns`` at the key of ``parent``."""

    child: str
    columns: Sequence[str]
    parent: str

    @property
    def index(self) -> str:
        return f"index-{self.child}-{self.parent}-{'-'.join(self.columns)}"


@dataclass(frozen=True)
class BucketedWarehouse:
    """A query over ``{table: current view}`` with one row at most per row of ``driving``.

    ``keys`` are the output columns that hold the driving table's key. ``links`` lead from the driving
    table to all others, without a cycle; a row takes part only if links from the driving row reach it.
    """

    query: Callable[[Mapping[str, DataFrame]], DataFrame]
    keys: Sequence[str]
    driving: str
    table_keys: Mapping[str, Sequence[str]]
    links: Sequence[Link]
    buckets: int = 256

    def order(self) -> list[str]:
        """The tables, each after all that point at it."""
        out: list[str] = []
        while len(out) < len(self.table_keys):
            ready = [t for t in self.table_keys if t not in out and all(x.child in out for x in self.links if x.parent == t)
                     and (t == self.driving or any(x.parent == t for x in self.links))]
            if not ready:
                raise ValueError(f"no links from {self.driving} lead to {sorted(set(self.table_keys) - set(out))}, or they form a cycle")
            out += ready
        return out


class BucketState:
    """Tables in folders by bucket and batch, below one path."""

    def __init__(self, spark: SparkSession, path: str, buckets: int):
        self.spark, self.path, self.buckets = spark, path, buckets
        #: Buckets read since the last refresh began, by table.
        self.read_buckets: dict[str, set[int]] = {}

    def bucket(self, keys: Sequence[str]) -> Column:
        return F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in keys]), F.lit(self.buckets)).cast("int")

    def numbers(self, rows: DataFrame, keys: Sequence[str]) -> list[int]:
        """The buckets of some keys: at most as many as there are."""
        return sorted(r[0] for r in rows.select(self.bucket(keys)).distinct().collect())

    def schema(self, name: str) -> StructType | None:
        text = snapshots.read_text(self.spark, f"{self.path}/{name}/{_SCHEMA}")
        return None if text is None else StructType.fromJson(json.loads(text))

    def remember(self, name: str, schema: StructType) -> None:
        """Keep a table's columns; those that come later are added."""
        known = self.schema(name)
        if known is None:
            snapshots.replace_text(self.spark, f"{self.path}/{name}/{_SCHEMA}", schema.json())
            return
        more = [f for f in schema.fields if f.name.lower() not in {k.lower() for k in known.names}]
        if more:
            snapshots.replace_text(self.spark, f"{self.path}/{name}/{_SCHEMA}", StructType([*known.fields, *more]).json())

    def write(self, name: str, rows: DataFrame, keys: Sequence[str], batch: int) -> None:
        """Store rows under a batch number; the same batch again replaces its folders.

        The shuffle is rebalanced at run time, so that a bucket with very many rows has many writers.
        """
        placed = rows.withColumns({_BUCKET: self.bucket(keys), _BATCH: F.lit(f"{batch:012d}")})
        placed.hint("rebalance", _BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
            .partitionBy(_BUCKET, _BATCH).parquet(f"{self.path}/{name}")

    def folders(self, name: str, numbers: Sequence[int], before: int | None = None, without: int | None = None) -> dict[int, list[str]]:
        """The batch folders of some buckets; with ``before`` only those of earlier batches, never that of batch ``without``."""
        out: dict[int, list[str]] = {n: [] for n in numbers}
        listed = ",".join(map(str, numbers))
        for path in snapshots.matching(self.spark, f"{self.path}/{name}/{_BUCKET}={{{listed}}}/{_BATCH}=*") if numbers else []:
            bucket, folder = path.split("/")[-2:]
            if (before is None or folder < f"{_BATCH}={before:012d}") and (without is None or folder != f"{_BATCH}={without:012d}"):
                out[int(bucket.split("=")[1])].append(folder)
        return {n: sorted(found) for n, found in out.items()}

    def read(self, name: str, numbers: Sequence[int], before: int | None = None, without: int | None = None) -> DataFrame:
        """The rows of some buckets."""
        found = self.folders(name, numbers, before, without)
        self.read_buckets.setdefault(name, set()).update(n for n, names in found.items() if names)
        paths = [f"{self.path}/{name}/{_BUCKET}={n}/{f}" for n, names in found.items() for f in names]
        schema = self.schema(name)
        if schema is None:
            raise ValueError(f"the first batch has to name the table {name}")
        reader = self.spark.read.schema(schema)
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], schema)


def _keys_of(rows: DataFrame, columns: Sequence[str], names: Sequence[str], types: StructType) -> DataFrame:
    """``columns`` as keys of a table whose columns are ``types``: under their names, of their types, no nulls."""
    return rows.select(*[F.col(f"`{c}`").cast(types[n].dataType).alias(n) for c, n in zip(columns, names)]).dropna()


def _parent_names(link: Link) -> list[str]:
    return [f"parent_{i}" for i in range(len(link.columns))]


def _store(state: BucketState, wh: BucketedWarehouse, changed: Mapping[str, DataFrame], number: int) -> None:
    for table, rows in changed.items():
        state.remember(table, rows.schema)
    for table, rows in changed.items():
        state.write(table, rows, wh.table_keys[table], number)
    for link in wh.links:
        if link.child not in changed:
            continue
        types, own = state.schema(link.parent), list(wh.table_keys[link.child])
        if types is None:
            raise ValueError(f"the first batch has to name the table {link.parent}")
        names = _parent_names(link)
        pointing = changed[link.child].select(
            *[F.col(f"`{c}`").cast(types[k].dataType).alias(n) for c, k, n in zip(link.columns, wh.table_keys[link.parent], names)],
            *[F.col(f"`{k}`") for k in own]).dropna(subset=names)
        state.remember(link.index, pointing.schema)
        state.write(link.index, pointing, names, number)


class _Keys(NamedTuple):
    """Distinct keys of a table, held for the batch, and the buckets they are in."""

    rows: DataFrame
    buckets: list[int]


def _distinct(state: BucketState, parts: Sequence[DataFrame], names: Sequence[str], held: list[DataFrame]) -> _Keys:
    rows = reduce(DataFrame.unionByName, parts).distinct().persist()
    held.append(rows)
    return _Keys(rows, state.numbers(rows, names))


def _mark(state: BucketState, wh: BucketedWarehouse, changed: Mapping[str, DataFrame], number: int, held: list[DataFrame]) -> _Keys | None:
    """Keys of the driving rows that the changes can alter.

    Pairs that this batch stored are not read back: their rows are among the changed ones.
    """
    marked: dict[str, _Keys] = {}
    for table in reversed(wh.order()):
        own, parts = list(wh.table_keys[table]), []
        if table in changed:
            parts.append(_keys_of(changed[table], own, own, state.schema(table)))
        for link in wh.links:
            if link.child == table and link.parent in marked:
                names, moved = _parent_names(link), marked[link.parent]
                # An index lies in the buckets of the parent's key.
                pointing = state.read(link.index, moved.buckets, without=number if table in changed else None)
                parts.append(pointing.join(moved.rows.toDF(*names), names, "left_semi").select(*own))
        if parts:
            keys = _distinct(state, parts, own, held)
            if keys.buckets:
                marked[table] = keys
    return marked.get(wh.driving)


def _views(state: BucketState, wh: BucketedWarehouse, marked: _Keys, held: list[DataFrame]) -> dict[str, DataFrame]:
    """Current views of what the marked driving rows need, from the buckets of those keys."""
    needed: dict[str, list[DataFrame]] = {}
    out: dict[str, DataFrame] = {}
    for table in wh.order():
        own = list(wh.table_keys[table])
        wanted = marked if table == wh.driving else _distinct(state, needed[table], own, held)
        rows = state.read(table, wanted.buckets).join(wanted.rows, own, "left_semi")
        view = current_view(rows, own).drop("version", "is_deleted", "ingest_seq")
        leaving = [link for link in wh.links if link.child == table]
        if leaving:
            held.append(view.persist())
        for link in leaving:
            keys = _keys_of(view, link.columns, wh.table_keys[link.parent], state.schema(link.parent))
            needed.setdefault(link.parent, []).append(keys)
        out[table] = view
    return out


def _present(target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The current view of target rows. A batch has one row of a key at most, so no key is
    hot and all rows are placed once, without a first sort for a partial aggregate."""
    return current_view(target.repartition(*[F.col(f"`{k}`") for k in keys]), keys, sequence=None)


def refresh(spark: SparkSession, path: str, wh: BucketedWarehouse, changed: Mapping[str, DataFrame], number: int,
            stamp: Column | None = None) -> dict[str, set[int]]:
    """Store a batch of changes and bring the target up to it; gives the buckets read, by table.

    ``changed`` has rows with ``version`` and ``is_deleted``; the first batch names every table, if only
    with no rows. ``number`` rises with every batch, from 1; the same number again changes nothing.
    """
    state, keys = BucketState(spark, path, wh.buckets), list(wh.keys)
    held: list[DataFrame] = []
    try:
        changed = {t: rows.withColumn("ingest_seq", F.lit(number).cast("long")).persist() for t, rows in changed.items()}
        held += changed.values()
        _store(state, wh, changed, number)
        marked = _mark(state, wh, changed, number, held)
        if marked is None:
            return state.read_buckets
        fresh = wh.query(_views(state, wh, marked, held))
        stamped = lambda rows, gone: rows.withColumns({
            "sync_dt": stamp if stamp is not None else F.now().cast("timestamp_ntz"),
            "version": F.lit(number).cast("long"), "is_deleted": F.lit(gone)})
        upserts = stamped(fresh, False).persist()
        held.append(upserts)
        state.remember(TARGET, upserts.schema)
        touched = _keys_of(marked.rows, wh.table_keys[wh.driving], keys, upserts.schema)
        missing = touched.join(upserts, keys, "left_anti").persist()
        held.append(missing)
        old = state.read(TARGET, state.numbers(touched, keys), before=number).select(*keys, "version", "is_deleted")
        if not missing.isEmpty():
            gone = current_view(old.join(missing, keys, "left_semi"), keys, sequence=None).select(*keys)
            upserts = upserts.unionByName(stamped(gone, True), allowMissingColumns=True)
        state.write(TARGET, upserts, keys, number)
        return state.read_buckets
    finally:
        for df in held:
            df.unpersist()


def read_target(spark: SparkSession, path: str, wh: BucketedWarehouse) -> DataFrame:
    """The target's current view, all buckets."""
    state = BucketState(spark, path, wh.buckets)
    return _present(state.read(TARGET, range(wh.buckets)), wh.keys).drop("sync_dt", "version", "is_deleted")


def run_bucketed(stream: DataFrame, split: Callable[[DataFrame], Mapping[str, DataFrame]], wh: BucketedWarehouse, path: str,
                 checkpoint: str, **trigger) -> StreamingQuery:
    """Refresh the target from a stream of changes, batch by batch; ``split`` gives ``{table: rows}``."""
    def each(batch: DataFrame, batch_id: int) -> None:
        batch.persist()  # read the source once for all tables
        try:
            refresh(batch.sparkSession, path, wh, split(batch), batch_id + 1)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint) \
        .trigger(**(trigger or {"availableNow": True})).start()


def compact_buckets(spark: SparkSession, path: str, wh: BucketedWarehouse, name: str, most: int = 8, before: int | None = None) -> int:
    """Reduce the buckets of a table, index or target that have more than ``most`` folders; gives the folders replaced.

    Latest rows stay, also delete records. ``before`` spares the folders of that batch and later
    ones. A bucket's new folder shows before its old ones go: rows are doubled in between,
    which the latest version does not mind. Not to be run while another job reads the buckets.
    """
    state = BucketState(spark, path, wh.buckets)
    found = {n: f for n, f in state.folders(name, range(wh.buckets), before).items() if len(f) > most}
    if not found:
        return 0
    rows = spark.read.schema(state.schema(name)).parquet(*[f"{path}/{name}/{_BUCKET}={n}/{f}" for n, names in found.items() for f in names])
    indexes = {link.index: _parent_names(link) for link in wh.links}
    if name in indexes:
        keys, rows = indexes[name], rows.distinct()
    else:
        keys = list(wh.keys if name == TARGET else wh.table_keys[name])
        rows = latest_version(rows, keys, sequence=None if name == TARGET else "ingest_seq")
    fresh = f"_compact-{uuid.uuid4().hex}"
    rows.withColumn(_BUCKET, state.bucket(keys)).hint("rebalance", _BUCKET).write.partitionBy(_BUCKET).parquet(f"{path}/{name}/{fresh}")
    for n, old in found.items():
        snapshots.swap_in(spark, f"{path}/{name}", f"{fresh}/{_BUCKET}={n}", f"{_BUCKET}={n}/{old[-1].split('.')[0]}.{fresh[9:]}",
                          [f"{_BUCKET}={n}/{f}" for f in old])
    snapshots.remove(spark, f"{path}/{name}/{fresh}")
    return sum(map(len, found.values()))
