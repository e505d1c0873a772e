"""A warehouse table kept equal to a query over the current views of its sources.

Each source table lands as versioned rows. A batch of changes does not re-run the
query over everything: it finds the target keys the batch can touch, recomputes
the query for those, and appends upserts and deletes. The target's current view
then equals the query over the current views of the sources.

The key lists in between are written tables: their size is known, so the planner
broadcasts the small ones and splits skewed partitions of what meets a large one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from evenkeel.operators.versioned import current_view, latest_version
from evenkeel.session import dropped_after, written
from evenkeel.sources import snapshots
from evenkeel.streaming.changes import backfill


@dataclass(frozen=True)
class Warehouse:
    """The query, what its rows are keyed by, and how they trace back to the sources.

    ``query`` takes ``{table: current view}``. ``links`` names, per table, which
    output columns hold that table's key, in the order of ``table_keys``: through
    them a changed source row finds the target rows it takes part in. A table
    linked by ``keys`` itself is the driving one.
    """

    query: Callable[[Mapping[str, DataFrame]], DataFrame]
    keys: Sequence[str]
    table_keys: Mapping[str, Sequence[str]]
    links: Mapping[str, Sequence[str]]

    def driving(self) -> str | None:
        return next((t for t, link in self.links.items() if list(link) == list(self.keys)), None)


def _view(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return current_view(rows, keys).drop("version", "is_deleted", "ingest_seq")


def views(landing: Mapping[str, DataFrame], wh: Warehouse) -> dict[str, DataFrame]:
    """Current views of all landing tables, without the landing columns."""
    return {name: _view(df, wh.table_keys[name]) for name, df in landing.items()}


def _stamped(rows: DataFrame, refresh: int, deleted: Column, stamp: Column | None) -> DataFrame:
    return rows.withColumns({
        "sync_dt": stamp if stamp is not None else F.now().cast("timestamp_ntz"),
        "version": F.lit(refresh).cast("long"), "is_deleted": deleted})


def populate(landing: Mapping[str, DataFrame], wh: Warehouse, stamp: Column | None = None) -> DataFrame:
    """The first fill: the whole query once, as version 0."""
    return _stamped(wh.query(views(landing, wh)), 0, F.lit(False), stamp)


def _renamed(rows: DataFrame, old: Sequence[str], new: Sequence[str]) -> DataFrame:
    return rows.select(*[F.col(f"`{a}`").alias(b) for a, b in zip(old, new)])


def _touched(changed: Mapping[str, DataFrame], landing: Mapping[str, DataFrame], old: DataFrame | None,
             wh: Warehouse) -> DataFrame:
    """Keys of all target rows the changes can alter; some that stay the same may be among them."""
    keys, driving, parts = list(wh.keys), wh.driving(), []
    for table, rows in changed.items():
        link = list(wh.links[table])
        moved = _renamed(rows, wh.table_keys[table], link)
        if table == driving:
            parts.append(moved)
        elif driving and set(link) <= set(landing[driving].columns):
            # Every driving row that ever pointed at a moved row: one pass over its landing, no shuffle of it.
            pointing = landing[driving].select(*[F.col(f"`{a}`").alias(b) for a, b in zip(wh.table_keys[driving], keys)],
                                               *[F.col(f"`{c}`") for c in link if c not in keys])
            parts.append(pointing.join(moved, link, "left_semi").select(*keys))
        else:
            parts.append(wh.query(views(landing, wh)).join(moved, link, "left_semi").select(*keys))
            if old is not None:
                parts.append(old.join(moved, link, "left_semi").select(*keys))
    return reduce(DataFrame.unionByName, parts).distinct()


def _views_of(touched: DataFrame, landing: Mapping[str, DataFrame], wh: Warehouse) -> dict[str, DataFrame]:
    """Current views cut down to what the touched keys need. The landing rows are cut
    before the latest version is picked, so only those take part in its shuffle."""
    driving = wh.driving()
    if driving is None:
        return views(landing, wh)
    keys = list(wh.table_keys[driving])
    wanted = _renamed(touched, wh.keys, keys)
    # Used by the query and to cut every other table, so the scan of the landing is done once.
    out = {driving: written(_view(landing[driving].join(wanted, keys, "left_semi"), keys), "driving")}
    for table, rows in landing.items():
        if table == driving:
            continue
        link, own = list(wh.links[table]), list(wh.table_keys[table])
        if set(link) <= set(out[driving].columns):
            used = written(_renamed(out[driving], link, own).distinct(), "used")
            rows = rows.join(used, own, "left_semi")
        out[table] = _view(rows, own)
    return out


def join_refresh(changed: Mapping[str, DataFrame], landing: Mapping[str, DataFrame], target: DataFrame | None,
                 wh: Warehouse, refresh: int, stamp: Column | None = None) -> DataFrame:
    """Target rows to append after a batch of changes.

    ``landing`` already holds the batch. The query is recomputed for the target
    keys the batch touches; touched keys that are in the target and no longer come
    out are appended as deletes, which carry the key alone. ``refresh`` must rise
    with every batch; it is the version of the appended rows.
    """
    keys = list(wh.keys)
    old = None if target is None else current_view(target, keys, sequence=None)
    touched = written(_touched(changed, landing, old, wh), "touched")
    fresh = wh.query(_views_of(touched, landing, wh))
    if wh.driving() is None:
        fresh = fresh.join(touched, keys, "left_semi")
    upserts = _stamped(fresh, refresh, F.lit(False), stamp)
    if target is None:
        return upserts
    upserts = written(upserts, "upserts")
    missing = touched.join(upserts, keys, "left_anti")
    gone = current_view(target.join(missing, keys, "left_semi"), keys, sequence=None).select(*keys)
    return upserts.unionByName(_stamped(gone, refresh, F.lit(True), stamp), allowMissingColumns=True)


def compact_batches(spark: SparkSession, path: str, keys: Sequence[str], sequence: str | None = "ingest_seq",
                    before: str | None = None) -> int:
    """Replace the batch folders of a table by one with the latest rows; gives the number replaced.

    ``before`` spares the folders from that name on, such as what a batch that is now
    repeated wrote. Delete records stay, so that late rows cannot undo them. The new folder shows
    before the old ones go: in between rows are doubled, which the latest version
    does not mind. Not to be run while another job reads the folders.
    """
    old = [name for name in snapshots.folders(spark, path, "batch=") if before is None or name < before]
    if len(old) < 2:
        return 0
    rows = spark.read.parquet(*[f"{path}/{name}" for name in old])
    fresh = f"_compact-{uuid.uuid4().hex}"
    latest_version(rows, keys, sequence=sequence).write.parquet(f"{path}/{fresh}")
    snapshots.swap_in(spark, path, fresh, f"{old[-1].split('.')[0]}.{fresh[9:]}", old)
    return len(old)


def run_warehouse(stream: DataFrame, split: Callable[[DataFrame], Mapping[str, DataFrame]], wh: Warehouse,
                  landing_path: str, target_path: str, checkpoint: str, compact_every: int | None = 100,
                  **trigger) -> StreamingQuery:
    """Land a stream of changes and refresh the target, batch by batch.

    ``split`` turns a micro-batch into ``{table: rows with version, is_deleted}``; the
    first batch has to name every table, if only with no rows. Every ``compact_every``
    batches the folders of all tables are reduced to their latest rows.
    Landing and target keep one folder per batch, overwritten when a batch repeats,
    so a restart neither loses nor doubles anything.
    """
    def refresh(batch: DataFrame, batch_id: int) -> None:
        with dropped_after(batch.sparkSession):
            refreshed(batch, batch_id)

    def refreshed(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        number = batch_id + 1  # 0 is the first fill
        folder = f"batch={number:012d}"
        if compact_every and number % compact_every == 0:  # nothing else reads between two batches
            for table, table_keys in wh.table_keys.items():
                compact_batches(spark, f"{landing_path}/{table}", table_keys, before=folder)
            compact_batches(spark, target_path, wh.keys, sequence=None, before=folder)
        batch.persist()  # read the source once for all tables
        try:
            changed, landing = {}, {}
            for table, rows in split(batch).items():
                rows.withColumn("ingest_seq", F.lit(number).cast("long")).write.mode("overwrite").parquet(
                    f"{landing_path}/{table}/{folder}")
                changed[table] = spark.read.parquet(f"{landing_path}/{table}/{folder}")
            for table in wh.table_keys:  # also those the batch does not change
                # Columns that came later are read too.
                landing[table] = spark.read.option("mergeSchema", True).parquet(f"{landing_path}/{table}/batch=*")
            target = _before(spark, target_path, number)
            out = join_refresh(changed, landing, target, wh, number)
            out.write.mode("overwrite").parquet(f"{target_path}/{folder}")
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint) \
        .trigger(**(trigger or {"availableNow": True})).start()


def _before(spark: SparkSession, path: str, number: int) -> DataFrame | None:
    """The target as it was before batch ``number``, from folders that were written to their end.

    None if there is none yet, also when the first write broke off.
    """
    if not snapshots.exists(spark, path):
        return None
    whole = [f for f in snapshots.folders(spark, path, "batch=") if snapshots.exists(spark, f"{path}/{f}/_SUCCESS")]
    if not whole:
        return None
    return spark.read.parquet(*[f"{path}/{f}" for f in whole]).filter(F.col("version") < number)


def resync(mode: str, landing: Mapping[str, DataFrame], target: DataFrame, wh: Warehouse,
           stamp: Column | None = None) -> DataFrame:
    """New contents for a target that is out of step; write them as a fresh snapshot.

    ``full`` is the query's result alone. ``missing`` keeps the target, adds the result
    under it (version 0 only fills gaps) and reduces it to one row per key.
    """
    fill = populate(landing, wh, stamp)
    if mode == "full":
        return fill
    if mode != "missing":
        raise ValueError(f"unknown mode: {mode}")
    return latest_version(target.unionByName(fill), wh.keys, sequence=None)


def add_source(target: Mapping[str, DataFrame], name: str, source: DataFrame, landing: DataFrame) -> dict[str, DataFrame]:
    """Another database joins a consolidation: its backfilled rows become one more named source."""
    if name in target:
        raise ValueError(f"source already present: {name}")
    return {**target, name: backfill(source, landing)}
