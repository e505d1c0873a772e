"""Versioned tables: latest rows, current views, consolidation, applying changes."""

from __future__ import annotations

import fnmatch
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from evenkeel.operators.diff import DIFFERENT, SOURCE_ONLY, TARGET_ONLY, dedupe_last
from evenkeel.session import written
from evenkeel.sources import snapshots

INSERT, UPDATE, DELETE = "INSERT", "UPDATE", "DELETE"


def latest_version(df: DataFrame, keys: Sequence[str], version: str = "version",
                   sequence: str | None = "ingest_seq") -> DataFrame:
    """One row per key: the highest version, ties to the last one taken in.

    One shuffle, after a partial aggregate that leaves one row per key and task.
    """
    order = [version] + ([sequence] if sequence and sequence in df.columns else [])
    return dedupe_last(df, keys, order)


def current_view(df: DataFrame, keys: Sequence[str], version: str = "version",
                 sequence: str | None = "ingest_seq", flag: str = "is_deleted") -> DataFrame:
    """Latest rows that are not deleted. The delete filter comes last: applied first it
    would bring deleted rows back."""
    return latest_version(df, keys, version, sequence).filter(~F.col(flag).cast("boolean"))


def consolidate(sources: Mapping[str, DataFrame], flag: str = "is_deleted", stamp: Column | None = None,
                keys: Sequence[str] = (), version: str = "version", sequence: str | None = "ingest_seq") -> DataFrame:
    """One frame over many sources, tagged ``source_db``, without deleted rows.

    With ``keys`` a source that carries versions is a landing: its latest rows are picked
    first, so that a delete hides the older versions of its key. Without keys the sources
    are taken to hold one row per key already.

    Versions of different databases do not compare, so keep ``source_db`` in the
    key of anything that picks a latest version. ``stamp`` adds ``sync_dt`` where
    a source has none.
    """
    parts = []
    for name, df in sources.items():
        if keys and flag in df.columns and version in df.columns:
            df = current_view(df, keys, version, sequence, flag)
        elif flag in df.columns:
            df = df.filter(F.col(flag).isNull() | ~F.col(flag).cast("boolean"))
        if stamp is not None and "sync_dt" not in df.columns:
            df = df.withColumn("sync_dt", stamp)
        parts.append(df.select(F.lit(name).alias("source_db"), *[F.col(f"`{c}`") for c in df.columns]))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def consolidate_query(query: Callable[[Mapping[str, DataFrame]], DataFrame],
                      sources: Mapping[str, Mapping[str, DataFrame]], stamp: Column | None = None) -> DataFrame:
    """Run one query on each source's own tables and put the results under one another."""
    return consolidate({name: query(tables) for name, tables in sources.items()},
                       stamp=stamp if stamp is not None else F.now().cast("timestamp_ntz"))


def copy_missing(source: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Source rows whose key the target lacks, one per key."""
    present = target.select(*keys).distinct()
    return dedupe_last(source, keys).join(present, list(keys), "left_anti").select(*source.columns)


def copy_if_empty(source: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The first copy: source rows if the target has none at all, else no rows."""
    return dedupe_last(source, keys) if target.isEmpty() else source.limit(0)


# ---------------------------------------------------------------- sync

def sync_plan(diff: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What brings the target in line: ``op`` plus the row's new values.

    INSERT carries all columns, UPDATE the new non-key values, DELETE the keys alone.
    Values have the source's types; one operation per key.
    """
    if not keys:
        raise ValueError("a sync needs keys")
    columns = [c[2:] for c in diff.columns if c.startswith("s_") and f"t_{c[2:]}" in diff.columns]
    op = (F.when(F.col("status") == SOURCE_ONLY, INSERT).when(F.col("status") == DIFFERENT, UPDATE)
          .when(F.col("status") == TARGET_ONLY, DELETE))
    types = {f.name: f.dataType for f in diff.schema.fields}
    values = [
        (F.coalesce(F.col(f"`s_{c}`"), F.col(f"`t_{c}`").cast(types[f"s_{c}"])) if c in keys
         else F.col(f"`s_{c}`")).alias(c) for c in columns]
    plan = diff.filter(F.col("status").isin(SOURCE_ONLY, DIFFERENT, TARGET_ONLY)).select(op.alias("op"), *values)
    return plan


def apply_plan(target: DataFrame, plan: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The target after the plan. Target columns the plan does not carry keep their values.

    Null keys are matched as in the comparison: null to null.
    """
    plan = dedupe_last(plan, keys, ["op"])
    carried = [c for c in plan.columns if c != "op" and c not in keys]
    types = {f.name: f.dataType for f in target.schema.fields}
    renamed = plan.select(*[F.col(f"`{k}`").cast(types[k]).alias(f"__key_{k}") for k in keys], F.col("op").alias("__op"),
                          *[F.col(f"`{c}`").alias(f"__new_{c}") for c in carried])
    same = reduce(lambda a, b: a & b, [F.col(f"`{k}`").eqNullSafe(F.col(f"`__key_{k}`")) for k in keys])
    merged = target.join(renamed, same, "left")
    updated = F.coalesce(F.col("__op") == UPDATE, F.lit(False))
    kept = merged.filter(F.coalesce(F.col("__op") != DELETE, F.lit(True))).select(*[
        (F.when(updated, F.col(f"`__new_{c}`").cast(types[c])).otherwise(F.col(f"`{c}`")).alias(c)
         if c in carried else F.col(f"`{c}`")) for c in target.columns])
    inserts = plan.filter(F.col("op") == INSERT).select(*[
        F.col(f"`{c}`").cast(types[c]).alias(c) for c in target.columns if c in plan.columns])
    return kept.unionByName(inserts, allowMissingColumns=True)


def plan_counts(plan: DataFrame) -> DataFrame:
    return plan.agg(*[F.count_if(F.col("op") == op).alias(name) for op, name in
                      ((INSERT, "inserted"), (UPDATE, "updated"), (DELETE, "deleted"))])


def apply_sync(spark: SparkSession, target_path: str, plan: DataFrame, keys: Sequence[str]) -> dict[str, int]:
    """Apply a plan to a snapshot table; readers see all of it or none of it."""
    target = snapshots.read_snapshot(spark, target_path)
    # Written once: the counts, the merge and the inserts read it, not the comparison.
    plan = written(dedupe_last(plan, keys, ["op"]), "sync-plan")
    counts = plan_counts(plan).first().asDict()
    snapshots.write_snapshot(apply_plan(target, plan, keys), target_path)
    return counts


def upsert(spark: SparkSession, target_path: str, changes: DataFrame, keys: Sequence[str],
           version: str = "version", sequence: str | None = "ingest_seq") -> str:
    """Merge versioned changes into a snapshot table: the latest version of each key.

    Delete records stay in the table, as they must hide older rows that come late; read it
    with ``read_upserted``. The result does not depend on the order of batches, and a
    repeated batch changes nothing.
    """
    merged = changes
    if snapshots.current_version(spark, target_path) is not None:
        merged = snapshots.read_snapshot(spark, target_path).unionByName(changes, allowMissingColumns=True)
    return snapshots.write_snapshot(latest_version(merged, keys, version, sequence), target_path)


def read_upserted(spark: SparkSession, target_path: str, flag: str = "is_deleted") -> DataFrame:
    """The rows of a table kept by ``upsert`` that are not deleted."""
    return snapshots.read_snapshot(spark, target_path).filter(~F.col(flag).cast("boolean"))


# ---------------------------------------------------------------- compaction

def compact(spark: SparkSession, path: str, keys: Sequence[str], version: str = "version",
            sequence: str | None = "ingest_seq") -> dict[str, int]:
    """Rewrite a snapshot table to its latest versions; delete records stay, as they
    still have to hide older rows elsewhere."""
    before_folder = snapshots.current_folder(spark, path)
    before = snapshots.folder_bytes(spark, before_folder)
    latest = latest_version(snapshots.read_snapshot(spark, path), keys, version, sequence)
    snapshots.write_snapshot(latest, path)
    after = snapshots.folder_bytes(spark, snapshots.current_folder(spark, path))
    return {"bytes_before": before, "bytes_after": after, "bytes_freed": max(before - after, 0)}


def matches_pattern(name: str, pattern: str | None) -> bool:
    """A pattern with ``%`` must fit the whole name, without it may sit anywhere; case is ignored."""
    if not pattern or not pattern.strip():
        return True
    low, pat = name.lower(), pattern.strip().lower()
    if "%" in pat:
        return fnmatch.fnmatchcase(low, pat.replace("[", "[[]").replace("?", "[?]").replace("*", "[*]").replace("%", "*"))
    return pat in low


def compact_many(spark: SparkSession, tables: Mapping[str, tuple[str, Sequence[str]]], pattern: str | None = None,
                 skip_landing: bool = False) -> DataFrame:
    """Compact the chosen tables ``{name: (path, keys)}``; one row per table, failures reported."""
    rows = []
    for name, (path, keys) in tables.items():
        if not matches_pattern(name, pattern) or (skip_landing and name.lower().startswith("cdc_")):
            continue
        try:
            sizes = compact(spark, path, keys)
            rows.append((name, "DONE", sizes["bytes_before"], sizes["bytes_after"], sizes["bytes_freed"], None))
        except Exception as error:  # report and go on with the other tables
            rows.append((name, "FAILED", None, None, None, str(error)))
    return spark.createDataFrame(
        rows, "table_name string, state string, bytes_before long, bytes_after long, bytes_freed long, error string")
