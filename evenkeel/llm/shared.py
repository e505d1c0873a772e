"""What the operators of this folder share: Arrow batches of bounded size, results, settings."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from evenkeel.session import ensure_checkpoint_dir, send_package

#: Rows of one Arrow batch. Batches with long documents are cut further by ``words.chunks``.
BATCH_ROWS = 256


def prepare(spark: SparkSession) -> None:
    """Let the Python workers find this package, and keep Arrow batches small.

    A batch of the default 10,000 rows of long documents would not fit in a worker.
    """
    send_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


class Scratch:
    """Tables written once to the shared folder, removed when the result no longer needs them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def written(self, df: DataFrame, label: str) -> DataFrame:
        path = f"{ensure_checkpoint_dir(self.spark)}/{label}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        """Remove the tables; nothing that is still to be computed may read them."""
        for path in self.paths:
            place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)
        self.paths = []


def documents(df: DataFrame, *others: str) -> DataFrame:
    """The columns the operators read: ``doc_id`` and ``text``, whatever else the table has.

    ``others`` name further columns that are wanted (the two may be among them). A null text stays null.
    """
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                     *(c for c in others if c not in ("doc_id", "text")))


def extended(ddl: str, held: DataFrame, others: Sequence[str]) -> StructType:
    """A schema of the columns in ``ddl`` and of further columns of ``held``."""
    return StructType([*StructType.fromDDL(ddl).fields, *(held.schema[c] for c in others)])


def by_batch(df: DataFrame, work: Callable[[pa.RecordBatch], list], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with a function from one batch to the arrays of the result's columns."""
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays(work(batch), names=names)

    return df.mapInArrow(run, schema)
