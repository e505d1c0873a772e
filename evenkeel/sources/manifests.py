"""A table kept in buckets of keys, with a manifest that names the folders of each bucket.

A batch rewrites only the buckets that its keys fall in, where ``write_snapshot`` rewrites the whole
table; all other files stay as they are, under their names. Buckets are ``pmod(xxhash64(keys), n)``, so
rows with one key meet in one bucket, and as a bucket holds one row a key, hot keys make none larger.

Layout: ``data/<write>/table_bucket=<b>/`` holds the rows, ``manifests/<write>.json`` the schema and for each
bucket the writes that make it up, and ``_CURRENT`` names the manifest in use. A manifest is a small list
(a few numbers a bucket). Readers see all of a write or none; a write that fails leaves a folder that
no manifest names, and the next one overwrites it. One writer at a time.

Cases: null keys are one key; repeated rows of a batch leave their latest version; an empty batch makes
an empty write; columns that a batch adds are null in older rows, and types are those first stored;
the column ``table_bucket`` is reserved, and a table that has it is an error.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from evenkeel.operators.diff import dedupe_last
from evenkeel.operators.versioned import apply_plan, latest_version, plan_counts
from evenkeel.session import dropped_after, written
from evenkeel.sources import snapshots

BUCKET = "table_bucket"


class BucketTable:
    """A table of versioned rows (or of plain rows, for ``apply``) in buckets of ``keys``."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], buckets: int = 256,
                 version: str = "version", sequence: str | None = "ingest_seq"):
        self.spark, self.path, self.keys, self.version, self.sequence = spark, path, list(keys), version, sequence
        held = self.manifest()
        if held and held["keys"] != self.keys:
            raise ValueError(f"the table has the keys {held['keys']}")
        self.buckets = held["buckets"] if held else buckets

    # ------------------------------------------------------------ manifests

    def _file(self, number: int) -> str:
        return f"{self.path}/manifests/{number:09d}.json"

    def manifest(self, number: int | None = None) -> dict | None:
        """The manifest in use (or an earlier one), None before the first write."""
        if number is None:
            name = snapshots.current_version(self.spark, self.path)
            if name is None:
                return None
            number = int(name)
        told = snapshots.read_text(self.spark, self._file(number))
        if told is None:
            raise FileNotFoundError(self._file(number))
        held = json.loads(told)
        return held | {"folders": {int(b): writes for b, writes in held["folders"].items()}}

    def _publish(self, schema: StructType, folders: dict[int, list[int]], number: int, batch: int | None) -> int:
        held = {"number": number, "keys": self.keys, "buckets": self.buckets, "batch": batch, "schema": schema.jsonValue(),
                "folders": {b: writes for b, writes in sorted(folders.items()) if writes}}
        snapshots.replace_text(self.spark, self._file(number), json.dumps(held))
        snapshots.publish(self.spark, self.path, str(number))
        return number

    # ------------------------------------------------------------ rows

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in self.keys]), F.lit(self.buckets)).cast("int")

    def _conform(self, rows: DataFrame, held: dict | None) -> DataFrame:
        """The rows in the stored types, as equal keys of other types would fall in other buckets."""
        if BUCKET in rows.columns:
            raise ValueError(f"{BUCKET} is the name of the bucket's number")
        types = {f.name: f.dataType for f in StructType.fromJson(held["schema"])} if held else {}
        return rows.select(*[F.col(f"`{c}`").cast(types[c]).alias(c) if c in types else F.col(f"`{c}`") for c in rows.columns])

    def _rows(self, held: dict | None, buckets: Sequence[int] | None = None) -> DataFrame | None:
        if held is None:
            return None
        paths = [f"{self.path}/data/{write}/{BUCKET}={b}" for b, writes in held["folders"].items()
                 if buckets is None or b in buckets for write in writes]
        schema = StructType.fromJson(held["schema"])
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, number: int | None = None) -> DataFrame:
        """All rows of the manifest in use, or of an earlier one that was kept."""
        rows = self._rows(self.manifest(number))
        if rows is None:
            raise FileNotFoundError(f"no table at {self.path}")
        return rows

    def current(self, flag: str = "is_deleted") -> DataFrame:
        """The latest rows that are not deleted, also of buckets that were appended to."""
        return latest_version(self.read(), self.keys, self.version, self.sequence).filter(~F.col(flag).cast("boolean"))

    def _touched(self, rows: DataFrame) -> set[int]:
        return {r[0] for r in rows.select(self.bucket().alias("b")).distinct().collect()}  # at most ``buckets``

    def _write(self, rows: DataFrame, number: int) -> list[int]:
        """Write rows to their buckets, a task each; give back the buckets that got any."""
        place = f"{self.path}/data/{number}"
        rows.withColumn(BUCKET, self.bucket()).repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(place)
        return [int(name.split("=")[1]) for name in snapshots.folders(self.spark, place, f"{BUCKET}=")]

    def _replace(self, held: dict | None, touched: set[int], rows: DataFrame, batch: int | None) -> int:
        """``rows`` become all that the touched buckets hold."""
        number = held["number"] + 1 if held else 1
        folders = dict(held["folders"]) if held else {}
        filled = set(self._write(rows, number))
        for b in touched:
            folders[b] = [number] if b in filled else []
        return self._publish(rows.schema, folders, number, batch)

    # ------------------------------------------------------------ writes

    def _latest(self, rows: DataFrame) -> DataFrame:
        return latest_version(rows, self.keys, self.version, self.sequence)

    def _repeated(self, held: dict | None, batch: int | None) -> bool:
        return held is not None and batch is not None and held["batch"] is not None and batch <= held["batch"]

    def upsert(self, changes: DataFrame, batch: int | None = None) -> int:
        """Merge versioned changes: the latest version of each key, deletes kept to hide late older rows.

        Reads and rewrites the touched buckets. A ``batch`` number that was taken in before changes nothing.
        """
        held = self.manifest()
        if self._repeated(held, batch):
            return held["number"]
        with dropped_after(self.spark):
            fresh = written(self._latest(self._conform(changes, held)), "upsert")
            touched, merged = self._touched(fresh), fresh
            if held:
                merged = self._latest(self._rows(held, touched).unionByName(fresh, allowMissingColumns=True))
            return self._replace(held, touched, merged, batch if batch is not None else (held or {}).get("batch"))

    def append(self, changes: DataFrame, batch: int | None = None) -> int:
        """Add the batch's latest rows beside those of their buckets and read nothing; ``compact`` brings them together."""
        held = self.manifest()
        if self._repeated(held, batch):
            return held["number"]
        fresh = self._latest(self._conform(changes, held))  # one row a key, so hot keys make no task longer
        number = held["number"] + 1 if held else 1
        folders = {b: list(writes) for b, writes in held["folders"].items()} if held else {}
        for b in self._write(fresh, number):
            folders.setdefault(b, []).append(number)
        schema = StructType.fromJson(held["schema"]) if held else StructType()
        schema = StructType([*schema.fields, *[f for f in fresh.schema.fields if f.name not in schema.names]])
        return self._publish(schema, folders, number, batch if batch is not None else (held or {}).get("batch"))

    def apply(self, plan: DataFrame) -> dict[str, int]:
        """Apply a plan of ``sync_plan`` to the touched buckets; counts of what was done."""
        held = self.manifest()
        if held is None:
            raise FileNotFoundError(f"no table at {self.path}")
        with dropped_after(self.spark):
            plan = written(dedupe_last(self._conform(plan, held), self.keys, ["op"]), "sync-plan")
            counts = plan_counts(plan).first().asDict()
            touched = self._touched(plan)
            if touched:
                self._replace(held, touched, apply_plan(self._rows(held, touched), plan, self.keys), held["batch"])
        return counts

    def sink(self) -> Callable[[DataFrame, int], None]:
        """For ``foreachBatch``: a batch that comes again after a restart changes nothing."""
        return lambda rows, number: self.upsert(rows, number) and None

    # ------------------------------------------------------------ upkeep

    def compact(self) -> int:
        """Bring buckets of several writes to their latest versions; the number of buckets rewritten."""
        held = self.manifest()
        parted = {b for b, writes in held["folders"].items() if len(writes) > 1} if held else set()
        if parted:
            self._replace(held, parted, self._latest(self._rows(held, parted)), held["batch"])
        return len(parted)

    def expire(self, keep: int = 1) -> int:
        """Delete what none of the last ``keep`` manifests names; the bytes that the disk has lost."""
        if keep < 1:
            raise ValueError("the manifest in use is always kept")
        held = self.manifest()
        if held is None:
            return 0
        before = snapshots.folder_bytes(self.spark, self.path)
        kept = [n for n in range(held["number"], max(0, held["number"] - keep), -1) if snapshots.exists(self.spark, self._file(n))]
        named = {(write, b) for n in kept for b, writes in self.manifest(n)["folders"].items() for write in writes}
        for write in map(int, snapshots.folders(self.spark, f"{self.path}/data")):
            if write > held["number"]:
                continue  # of a write that is not done yet
            place = f"{self.path}/data/{write}"
            found = {int(name.split("=")[1]) for name in snapshots.folders(self.spark, place, f"{BUCKET}=")}
            stale = {b for b in found if (write, b) not in named}
            if stale == found:
                snapshots.remove(self.spark, place)
            else:
                for b in stale:
                    snapshots.remove(self.spark, f"{place}/{BUCKET}={b}")
        for old in snapshots.matching(self.spark, f"{self.path}/manifests/*.json"):
            if int(old.rsplit("/", 1)[1].split(".")[0]) < kept[-1]:
                snapshots.remove(self.spark, old)
        return before - snapshots.folder_bytes(self.spark, self.path)
