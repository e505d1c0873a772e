"""CSV files in, CSV folders out."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from evenkeel.functions.equality import BLANKS, is_nested, trim_blanks


def sanitize_names(names: Sequence[str | None]) -> list[str]:
    """Column names of letters, digits and single underscores, in lower case and distinct."""
    out: list[str] = []
    for position, raw in enumerate(names, 1):
        name = re.sub(r"_+", "_", re.sub(r"[^a-zA-Z0-9_]", "_", raw or "")).lower() if raw and raw.strip() else ""
        if name[:1].isdigit():
            name = f"col_{name}"
        if name in ("", "_"):
            name = f"column_{position}"
        candidate, n = name, 0
        while candidate in out:
            n += 1
            candidate = f"{name}_{n}"
        out.append(candidate)
    return out


def sanitize_table_name(name: str) -> str:
    text = re.sub(r"_+", "_", re.sub(r"[^a-zA-Z0-9_]", "_", name.strip())).lower()
    return f"tbl_{text}" if text[:1].isdigit() or text in ("", "_") else text


def sanitize_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*sanitize_names(df.columns))


def find_delimiter(line: str) -> str:
    """``;`` or tab if it occurs strictly more often than both others, else a comma."""
    commas, semicolons, tabs = (line.count(mark) for mark in ",;\t")
    if semicolons > commas and semicolons > tabs:
        return ";"
    return "\t" if tabs > commas and tabs > semicolons else ","


def csv_ingest(spark: SparkSession, path: str) -> DataFrame:
    """Read a CSV file as text columns: delimiter from its first line, quotes doubled,
    fields trimmed, short rows filled with empty text, blank rows left out.

    A record ends at the line end. The file is read in parallel splits.
    """
    lines = spark.read.text(path)
    head = lines.filter(trim_blanks(F.col("value")) != "").first()
    if head is None:
        raise ValueError(f"empty CSV file: {path}")
    delimiter = find_delimiter(head["value"])
    options = dict(sep=delimiter, quote='"', escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    width = len(_split_line(head["value"], delimiter))
    header = spark.createDataFrame([(head["value"].removeprefix("\ufeff"),)], "value string").select(
        F.from_csv("value", ", ".join(f"_c{i} string" for i in range(width)), {k: str(v) for k, v in options.items()}))
    names = header.first()[0]
    columns = sanitize_names(list(names))
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    rows = spark.read.csv(path, schema=schema, header=True, nullValue="\u0000", emptyValue="", mode="PERMISSIVE",
                          enforceSchema=True, **options)
    rows = rows.select(*[F.coalesce(F.btrim(c, F.lit(BLANKS)), F.lit("")).alias(c) for c in columns])
    return rows.filter(reduce(lambda a, b: a | b, [F.col(c) != "" for c in columns]))


def _split_line(line: str, delimiter: str) -> list[str]:
    """Fields of one line; used on the header only."""
    return re.split(rf"{re.escape(delimiter)}(?=(?:[^\"]*\"[^\"]*\")*[^\"]*$)", line)


def csv_export(df: DataFrame, path: str) -> None:
    """Write quoted CSV with CRLF line ends; nested values as JSON, null as empty text.

    A byte order mark has no meaning on part files and is left out.
    """
    fields = [(F.to_json(F.col(f"`{f.name}`")) if is_nested(f.dataType) else F.col(f"`{f.name}`").cast("string"))
              .alias(f.name) for f in df.schema.fields]
    df.select(*[F.coalesce(c, F.lit("")).alias(n) for c, n in zip(fields, df.columns)]).write.mode("errorifexists").csv(
        path, header=True, quoteAll=True, quote='"', escape='"', lineSep="\r\n", emptyValue="", nullValue="",
        encoding="UTF-8")
