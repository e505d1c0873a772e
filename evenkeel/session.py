"""Session settings shared by tests, benchmarks and jobs."""

from __future__ import annotations

import contextlib
import contextvars
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "evenkeel", cores: str = "8", memory: str = "16g", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder of the session.

    A cluster names it in ``spark.checkpoint.dir``. A machine-local folder is
    used only by a local master that names none; a cluster without the setting
    is an error, because executors could not read each other's files there.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        named = tempfile.mkdtemp(prefix=f"evenkeel-checkpoint-{os.getpid()}-")
    context.setCheckpointDir(named)
    return context.getCheckpointDir() or named


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, if its input is too small to give every core a split of its own.

    For work that takes long on few bytes: one small file would be one task. What is shuffled is at
    most a split a core by the planner's estimate; larger inputs stay as they are. Rows are the same either way.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    split = int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes")))
    return df.repartition(cores) if size < cores * split else df


def small_batches(spark: SparkSession, rows: int = 256, size: int = 16 << 20) -> None:
    """Keep the Arrow batches of this session to so many rows and bytes, where they are larger.

    The default 10,000 rows of long texts take as much memory in every Python worker.
    """
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        held = spark.conf.get(f"spark.sql.execution.arrow.{name}", str((1 << 31) - 2)).rstrip("b")
        if not held.isdigit() or not 0 < int(held) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as a table in the shared checkpoint folder and read back.

    Cuts the lineage: what follows sees the same rows each time, also after an
    executor is lost, and the planner knows their size.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    if (paths := _tables.get()) is not None:
        paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_tables: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("tables", default=None)


@contextlib.contextmanager
def dropped_after(spark: SparkSession) -> Iterator[None]:
    """Remove at the end every table that ``written`` makes inside, as a stream must after each batch.

    What is still to be computed afterwards may not read them.
    """
    paths: list[str] = []
    token = _tables.set(paths)
    try:
        yield
    finally:
        _tables.reset(token)
        for path in paths:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


_sent: set[str] = set()


def send_package(spark: SparkSession) -> None:
    """Give this package to the Python workers, once per application.

    For sessions started without ``--py-files``: Spark serves the archive from the
    driver to all executors.
    """
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    place = os.path.join(tempfile.mkdtemp(prefix="evenkeel-package-"), "evenkeel")
    archive = shutil.make_archive(place, "zip", os.path.dirname(package), os.path.basename(package))
    spark.sparkContext.addPyFile(archive)
    _sent.add(app)
