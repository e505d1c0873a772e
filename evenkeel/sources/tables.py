"""Reading tables and queries, from files or over JDBC."""

from __future__ import annotations

import datetime
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

# URL form per database type; other types are refused.
JDBC_URLS = {
    "postgresql": "jdbc:postgresql://{host}:{port}/{database}",
    "mysql": "jdbc:mysql://{host}:{port}/{database}",
    "mariadb": "jdbc:mariadb://{host}:{port}/{database}",
    "sqlserver": "jdbc:sqlserver://{host}:{port};databaseName={database}",
    "clickhouse": "jdbc:clickhouse://{host}:{port}/{database}",
}
FETCH_SIZE = 10_000
WRITE_WORDS = re.compile(r"\b(insert|update|delete|drop|alter|truncate|exec|execute)\s", re.I)


@dataclass(frozen=True)
class Source:
    """Where data lies: a folder of files, or a database reached over JDBC.

    ``format`` is a file format (``path`` is then the folder) or ``jdbc`` with a
    full ``url``, or with ``type``, ``host``, ``port`` and ``database``.
    """

    format: str = "parquet"
    path: str | None = None
    url: str | None = None
    type: str | None = None
    host: str | None = None
    port: int | None = None
    database: str | None = None
    options: Mapping[str, str] = field(default_factory=dict)

    def jdbc_url(self) -> str:
        if self.url:
            return self.url
        kind = (self.type or "").lower()
        if kind not in JDBC_URLS:
            raise ValueError(f"unsupported database type: {self.type!r}")
        return JDBC_URLS[kind].format(host=self.host, port=self.port, database=self.database)


def only_select(sql: str) -> str:
    """The query without a closing semicolon; a query with a writing word is refused."""
    text = sql.strip().rstrip(";").strip()
    bare = re.sub(r"'(?:[^']|'')*'|\"[^\"]*\"|--[^\n]*|/\*.*?\*/", " ", text, flags=re.S)
    if not re.match(r"(?is)^\s*(select|with|values|\()", bare) or WRITE_WORDS.search(bare) or ";" in bare:
        raise ValueError("only one reading query is allowed")
    return text


def scan(spark: SparkSession, source: Source, table: str | None = None, query: str | None = None,
         partition_column: str | None = None, bounds: Sequence | None = None, partitions: int | None = None) -> DataFrame:
    """A table or a query of a source.

    Filters and column choices reach the files or the database by themselves. For
    JDBC give ``partition_column`` and ``bounds`` to read in parallel ranges; rows
    outside the bounds are still read, by the first and last range.
    """
    if (table is None) == (query is None):
        raise ValueError("give a table or a query")
    if source.format != "jdbc":
        if query is not None:
            return spark.sql(only_select(query))
        return spark.read.format(source.format).options(**source.options).load(f"{source.path}/{table}")
    dbtable = table if table is not None else f"({only_select(query)}) q"
    reader = spark.read.format("jdbc").options(
        url=source.jdbc_url(), dbtable=dbtable, fetchsize=FETCH_SIZE, **source.options)
    if partition_column:
        if bounds is None:
            edges = spark.read.format("jdbc").options(
                url=source.jdbc_url(), dbtable=f"(SELECT MIN({partition_column}) AS lo, MAX({partition_column}) AS hi "
                                               f"FROM {dbtable}{'' if table is None else ' t'}) b", **source.options).load().first()
            bounds = (edges[0], edges[1])
        if bounds[0] is not None:
            reader = reader.options(
                partitionColumn=partition_column, lowerBound=str(bounds[0]), upperBound=str(bounds[1]),
                numPartitions=partitions or spark.sparkContext.defaultParallelism)
    return reader.load()


def register_tables(spark: SparkSession, folder: str, names: Sequence[str]) -> None:
    """Temp views over ``<folder>/<name>.parquet``."""
    for name in names:
        spark.read.parquet(f"{folder}/{name}.parquet").createOrReplaceTempView(name)


def system_values(now: datetime.datetime | None = None, **given) -> dict:
    """Values every query may name: time and, where known, user, app, role and company."""
    now = now or datetime.datetime.now()
    values = {"sys_now": now, "sys_today": now.date(), "sys_user": None, "sys_app": None,
              "sys_role": None, "sys_company": None}
    return values | {k: v for k, v in given.items() if v is not None}


def bind_params(sql: str, params: Mapping | None = None, defaults: Mapping | None = None,
                system: Mapping | None = None) -> dict:
    """The values for the ``:name`` markers of a query: given, else default, else system."""
    pool = {**system_values(), **(system or {})}
    pool |= {k: v for k, v in (defaults or {}).items() if v is not None}
    pool |= {k: v for k, v in (params or {}).items() if v is not None or k not in pool}
    bare = re.sub(r"'(?:[^']|'')*'", " ", sql)
    used = set(re.findall(r"(?<!:):([A-Za-z_]\w*)", bare))
    missing = sorted(used - set(pool))
    if missing:
        raise ValueError(f"no value for: {', '.join(missing)}")
    return {name: pool[name] for name in used}


def adhoc_query(spark: SparkSession, sql: str, params: Mapping | None = None, defaults: Mapping | None = None,
                system: Mapping | None = None) -> DataFrame:
    """Run one reading query over the registered views, with bound values."""
    return spark.sql(only_select(sql), args=bind_params(sql, params, defaults, system))


def total_rows(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"))


def preview(df: DataFrame, n: int = 200) -> DataFrame:
    return df.limit(n)
