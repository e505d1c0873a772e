"""A table as numbered snapshot folders and a small file naming the current one.

Plain Parquet cannot be replaced while it is read, so each write goes to a new
folder and then the pointer file is swapped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

POINTER = "_CURRENT"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def exists(spark: SparkSession, path: str) -> bool:
    fs, path_of = _fs(spark, path)
    return fs.exists(path_of(path))


def folders(spark: SparkSession, path: str, prefix: str = "") -> list[str]:
    """Names of the folders below ``path`` that start with ``prefix``."""
    fs, path_of = _fs(spark, path)
    if not fs.exists(path_of(path)):
        return []
    found = [s.getPath().getName() for s in fs.listStatus(path_of(path)) if s.isDirectory()]
    return sorted(name for name in found if name.startswith(prefix))


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that a pattern with ``*`` and ``{a,b}`` matches, in order."""
    fs, path_of = _fs(spark, pattern)
    return sorted(s.getPath().toString() for s in fs.globStatus(path_of(pattern)) or [])


def swap_in(spark: SparkSession, path: str, fresh: str, name: str, replaced: list[str]) -> None:
    """Show the folder ``fresh`` as ``name``, then drop the folders it replaces."""
    fs, path_of = _fs(spark, path)
    if not fs.rename(path_of(f"{path}/{fresh}"), path_of(f"{path}/{name}")):
        raise OSError(f"cannot rename {path}/{fresh}")
    for old in replaced:
        fs.delete(path_of(f"{path}/{old}"), True)


def folder_bytes(spark: SparkSession, path: str) -> int:
    fs, path_of = _fs(spark, path)
    return fs.getContentSummary(path_of(path)).getLength()


def read_text(spark: SparkSession, file: str) -> str | None:
    """The text of a small file, or None if there is none."""
    fs, path_of = _fs(spark, file)
    if not fs.exists(path_of(file)):
        return None
    stream = fs.open(path_of(file))
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def current_version(spark: SparkSession, path: str) -> str | None:
    version = read_text(spark, f"{path}/{POINTER}")
    return None if version is None else version.strip()


def current_folder(spark: SparkSession, path: str) -> str | None:
    version = current_version(spark, path)
    return None if version is None else f"{path}/{version}"


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    folder = current_folder(spark, path)
    if folder is None:
        raise FileNotFoundError(f"no snapshot at {path}")
    return spark.read.parquet(folder)


def publish(spark: SparkSession, path: str, version: str) -> None:
    """Make ``version`` the current folder; the rename replaces the pointer in one step."""
    replace_text(spark, f"{path}/{POINTER}", version)


def replace_text(spark: SparkSession, file: str, text: str) -> None:
    """Write a small file; readers see the old text or the new one, never a part."""
    fs, path_of = _fs(spark, file)
    fresh, pointer = path_of(f"{file}.next"), path_of(file)
    stream = fs.create(fresh, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    context = spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    overwrite = spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    options = spark.sparkContext._gateway.new_array(
        spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = overwrite
    context.rename(fs.makeQualified(fresh), fs.makeQualified(pointer), options)


def write_snapshot(df: DataFrame, path: str, version: str | None = None, **write_options) -> str:
    """Write ``df`` as the next snapshot and publish it; give back its version.

    A given ``version`` (such as a batch number) is overwritten, so a repeated
    write of the same batch changes nothing. The frame may read the current one.
    """
    spark = df.sparkSession
    current = current_version(spark, path)
    if version is None:
        last = int(current[2:]) if current and current[2:].isdigit() else 0
        version = f"v={last + 1}"
    if version == current:
        raise ValueError(f"{version} is the current snapshot and may be in use")
    df.write.mode("overwrite").options(**write_options).parquet(f"{path}/{version}")
    publish(spark, path, version)
    return version


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, if it is there."""
    fs, path_of = _fs(spark, path)
    fs.delete(path_of(path), True)
