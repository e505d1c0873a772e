"""Registry of queries over the standard tables, each with its SQL for checking."""

from __future__ import annotations

import functools
import uuid
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evenkeel.session import ensure_checkpoint_dir, send_package

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of one folder, read when first named."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        send_package(spark)

    @functools.cache
    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        """Run SQL that names tables as ``{orders}``; the same text serves the checking engine."""
        for name in TABLES:
            if "{%s}" % name in text:
                view = f"v{zlib.crc32(self.folder.encode()):08x}_{name}"
                getattr(self, name).createOrReplaceTempView(view)
                text = text.replace("{%s}" % name, view)
        return self.spark.sql(text)

    def scratch(self, label: str) -> str:
        """A fresh folder in the session's shared checkpoint place."""
        return f"{ensure_checkpoint_dir(self.spark)}/{label}-{uuid.uuid4().hex}"


def plain(text: str) -> str:
    """The same SQL with bare table names."""
    for name in TABLES:
        text = text.replace("{%s}" % name, name)
    return text


def query(name: str, oracle: str | None = None):
    """Register a query; ``oracle`` is its SQL, or None where SQL cannot say it."""

    def register(body: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: body(Tables(spark, folder))
        if oracle is not None:
            ORACLES[name] = plain(oracle).strip()
        return body

    return register
