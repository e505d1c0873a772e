"""Schemas as frames: listing, comparing, mapping and evolving them."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from evenkeel.operators.diff import dedupe_last
from evenkeel.operators.skew import join_unique
from evenkeel.sources import snapshots

IDENTICAL, DIFFERENT, SOURCE_ONLY, TARGET_ONLY = "IDENTICAL", "DIFFERENT", "SOURCE_ONLY", "TARGET_ONLY"

# The Spark type for each database type name (exact names, without size).
TYPE_NAMES = {
    "bigint": "bigint", "int8": "bigint", "bigserial": "bigint",
    "smallint": "smallint", "int2": "smallint", "tinyint": "smallint",
    "int": "int", "integer": "int", "int4": "int", "serial": "int",
    "real": "float", "float4": "float", "float": "float",
    "double": "double", "double precision": "double", "float8": "double",
    "bool": "boolean", "boolean": "boolean", "bit": "boolean",
    "date": "date", "time": "string",
    "timestamp": "timestamp_ntz", "timestamptz": "timestamp_ntz", "datetime": "timestamp_ntz",
    "timestamp without time zone": "timestamp_ntz", "timestamp with time zone": "timestamp_ntz",
    "uuid": "string", "json": "string", "jsonb": "string", "text": "string", "char": "string",
    "varchar": "string", "character varying": "string", "bpchar": "string",
    "bytea": "binary", "blob": "binary", "varbinary": "binary",
}


def spark_type(type_name: str) -> str:
    """The Spark type of a database type such as ``numeric(12,2)`` or ``varchar(40)``.

    Decimals keep their precision; without one they read as doubles. Unknown types are text.
    """
    m = re.fullmatch(r"\s*([A-Za-z0-9_ ]+?)\s*(?:\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\))?\s*", type_name)
    if not m:
        return "string"
    name, precision, scale = m.group(1).lower(), m.group(2), m.group(3)
    if name in ("numeric", "decimal"):
        return f"decimal({min(int(precision), 38)},{scale or 0})" if precision else "double"
    return TYPE_NAMES.get(name, "string")


def _size(dtype: T.DataType) -> int | None:
    if isinstance(dtype, T.DecimalType):
        return dtype.precision
    if isinstance(dtype, (T.VarcharType, T.CharType)):
        return dtype.length
    return None


_FRAME = "table_name string, position int, name string, type string, size int, nullable boolean, is_pk boolean"


def _schema_rows(df: DataFrame, table: str, keys: Sequence[str]) -> list[tuple]:
    lower = {k.lower() for k in keys}
    return [(table, i, f.name, f.dataType.simpleString(), _size(f.dataType), f.nullable, f.name.lower() in lower)
            for i, f in enumerate(df.schema.fields, 1)]


def schema_frame(df: DataFrame, table: str, keys: Sequence[str] = ()) -> DataFrame:
    """Name, type, size, nullability and key membership per column."""
    return df.sparkSession.createDataFrame(_schema_rows(df, table, keys), _FRAME)


def schema_compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Compare two schema frames column by column; names are case-sensitive.

    Frames of many tables are compared table by table.
    """
    left = a.select("table_name", "name", F.struct("type", "size", "nullable", "is_pk").alias("source"))
    right = b.select("table_name", "name", F.struct("type", "size", "nullable", "is_pk").alias("target"))
    status = (F.when(F.col("target").isNull(), SOURCE_ONLY).when(F.col("source").isNull(), TARGET_ONLY)
              .when(F.col("source").eqNullSafe(F.col("target")), IDENTICAL).otherwise(DIFFERENT))
    return left.join(right, ["table_name", "name"], "full_outer").select(
        "table_name", "name", status.alias("status"),
        *[F.col(f"{side}.{c}").alias(f"{side}_{c}") for side in ("source", "target")
          for c in ("type", "size", "nullable", "is_pk")])


def catalog_frame(spark: SparkSession, tables: Mapping[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """One schema frame for many tables ``{name: (frame, keys)}``."""
    rows = [row for name, (df, keys) in tables.items() for row in _schema_rows(df, name, keys)]
    return spark.createDataFrame(rows, _FRAME)


def schema_compare_all(a: DataFrame, b: DataFrame) -> DataFrame:
    """Status per table: one-sided tables, else DIFFERENT if any column is not identical."""
    columns = schema_compare(a, b)
    n = F.count(F.lit(1))
    status = (F.when(F.col("source_only") == F.col("column_count"), SOURCE_ONLY)
              .when(F.col("target_only") == F.col("column_count"), TARGET_ONLY)
              .when(F.col("identical") == F.col("column_count"), IDENTICAL).otherwise(DIFFERENT))
    counts = columns.groupBy("table_name").agg(
        n.alias("column_count"), *[F.count_if(F.col("status") == s).alias(s.lower())
                                   for s in (IDENTICAL, DIFFERENT, SOURCE_ONLY, TARGET_ONLY)])
    return counts.withColumn("status", status)


def auto_map(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pair the tables of two catalogs by name, with the keys found on either side."""
    def keyed(df: DataFrame, side: str) -> DataFrame:
        keys = F.array_sort(F.collect_list(F.when(F.col("is_pk"), F.struct("position", "name"))))
        return df.groupBy("table_name").agg(F.transform(keys, lambda k: k["name"]).alias(f"{side}_keys")) \
            .withColumn(f"{side}_table", F.col("table_name"))

    both = keyed(a, "source").join(keyed(b, "target"), "table_name", "full_outer")
    keys = F.when(F.size("source_keys") > 0, F.col("source_keys")).otherwise(F.col("target_keys"))
    return both.select("table_name", "source_table", "target_table", keys.alias("keys"))


def evolve(df: DataFrame, schema: T.StructType, source: DataFrame | None = None,
           keys: Sequence[str] = ()) -> DataFrame:
    """Bring a frame to a new schema: removed columns go, new ones come as nulls.

    With ``source`` the new columns are filled from its rows of the same key.
    """
    have = {f.name for f in df.schema.fields}
    added = [f for f in schema.fields if f.name not in have]
    if source is not None and added and keys:
        fill = source.select(*keys, *[F.col(f.name).cast(f.dataType).alias(f.name) for f in added])
        df = join_unique(df, dedupe_last(fill, keys), keys)
        added = []
    df = df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in added}) if added else df
    return df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields])


def detect_keys(columns: Sequence[str], table_keys: Sequence[str]) -> list[str]:
    """Key columns of a query's output: the tables' keys that are present, else a column
    ending in ``_<key>``, else the first column."""
    lower = {c.lower(): c for c in reversed(columns)}
    found: list[str] = []
    for key in table_keys:
        hit = lower.get(key.lower())
        if hit is None:
            hit = next((c for c in columns if c.lower().endswith(f"_{key.lower()}")), None)
        if hit is not None and hit not in found:
            found.append(hit)
    return found or list(columns[:1])


def table_stats(df: DataFrame, path: str | None = None) -> DataFrame:
    """Row count, and bytes of the files under ``path`` if given."""
    counted = df.agg(F.count(F.lit(1)).alias("row_count"))
    if path is None:
        return counted
    return counted.withColumn("total_bytes", F.lit(snapshots.folder_bytes(df.sparkSession, path)).cast("long"))


def check_landing_schema(df: DataFrame) -> list[str]:
    """Landing columns the table lacks, ignoring case; empty means it conforms."""
    have = {c.lower() for c in df.columns}
    return [c for c in ("seq", "kode_data", "detail_data", "input_by", "input_dt") if c not in have]
