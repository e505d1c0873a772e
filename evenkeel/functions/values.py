"""Scalar helpers as Column expressions: sizes, phones, dates, templates, defaults."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

# The ranges a warehouse date and timestamp column can hold.
DATE_RANGE = ("1970-01-01", "2148-12-31")
TIMESTAMP_RANGE = ("1970-01-01 00:00:00", "2105-12-31 23:59:59")
CLOCK_PATTERN = r"^\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?$"
PLACEHOLDER = re.compile(r"\{\{\s*([A-Za-z0-9_]+)\s*\}\}")
COUNTRY_CODE = "62"


def format_bytes(col: Column) -> Column:
    """Readable size: ``B``, ``KiB`` with one decimal, ``MiB`` and ``GiB`` with two."""
    size = col.cast("double")
    return (
        F.when(col < 1024, F.concat(col.cast("long").cast("string"), F.lit(" B")))
        .when(col < 1024 ** 2, F.format_string("%.1f KiB", size / 1024))
        .when(col < 1024 ** 3, F.format_string("%.2f MiB", size / 1024 ** 2))
        .otherwise(F.when(col.isNotNull(), F.format_string("%.2f GiB", size / 1024 ** 3)))
    )


def normalize_phone(col: Column) -> Column:
    """Digits only; one leading 0 becomes the country code; null becomes empty."""
    digits = F.regexp_replace(F.coalesce(col.cast("string"), F.lit("")), "[^0-9]", "")
    return F.when(digits.startswith("0"), F.concat(F.lit(COUNTRY_CODE), F.substring(digits, 2, 2147483647))) \
        .otherwise(digits)


def score_band(col: Column) -> Column:
    """Band of a match score."""
    return F.when(col > 80, "very high").when(col > 60, "high").when(col > 40, "medium").otherwise("low")


def clamp_dates(df: DataFrame, date_range: Sequence[str] = DATE_RANGE,
                timestamp_range: Sequence[str] = TIMESTAMP_RANGE) -> DataFrame:
    """Move dates and timestamps outside the storable years to the range ends; nulls stay."""
    out = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, T.DateType):
            low, high = date_range
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            low, high = timestamp_range
        else:
            continue
        col = F.col(f"`{f.name}`")
        out[f.name] = (
            F.when(F.year(col) < int(low[:4]), F.lit(low).cast(f.dataType))
            .when(F.year(col) > int(high[:4]), F.lit(high).cast(f.dataType))
            .otherwise(col)
        )
    return df.withColumns(out) if out else df


def time_to_timestamp(col: Column) -> Column:
    """Clock text ``H:MM[:SS[.f]]`` on 1970-01-01; other text is read as a timestamp, else null."""
    text = F.trim(col)
    padded = F.when(text.rlike(r"^\d:"), F.concat(F.lit("0"), text)).otherwise(text)
    stamp = F.when(text.rlike(CLOCK_PATTERN), F.concat(F.lit("1970-01-01 "), padded)).otherwise(text)
    return stamp.try_cast(T.TimestampNTZType())


def decode_epoch(col: Column, unit: str = "days") -> Column:
    """A date sent as a number of days, or of milli-, micro- or plain seconds, since 1970."""
    number = col.cast("long")
    if unit == "days":
        return F.date_from_unix_date(number.cast("int"))
    makers = {"millis": F.timestamp_millis, "micros": F.timestamp_micros, "seconds": F.timestamp_seconds}
    if unit not in makers:
        raise ValueError(f"unknown unit: {unit}")
    return makers[unit](number).cast("date")


def render_template(df: DataFrame, template: str, out: str = "message", direct: str | None = None) -> DataFrame:
    """Fill ``{{ name }}`` from the columns, ignoring case; null and unknown give empty text.

    The template is cut up once, into one concat over columns. A blank template, or
    one that is only the ``direct`` column, takes that column as it is.
    """
    names = {c.lower(): c for c in reversed(df.columns)}

    def text(name: str) -> Column:
        column = names.get(name.lower())
        return F.lit("") if column is None else F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))

    if direct and direct.lower() in names and template.strip().lower() in ("", "{{%s}}" % direct.lower()):
        return df.withColumn(out, text(direct))
    parts = PLACEHOLDER.split(template)
    pieces = [F.lit(part) if i % 2 == 0 else text(part) for i, part in enumerate(parts) if i % 2 or part]
    return df.withColumn(out, F.concat(*pieces) if pieces else F.lit(""))


def normalize_record(df: DataFrame, defaults: Mapping[str, object] | None = None,
                     year_column: str | None = None) -> DataFrame:
    """Nulls become the field's default: given, or empty text, or zero for numbers.

    ``year_column`` adds ``<name>_init``, empty for a year of 0.
    """
    defaults = dict(defaults or {})
    out = {}
    for f in df.schema.fields:
        if f.name in defaults:
            out[f.name] = F.coalesce(F.col(f"`{f.name}`"), F.lit(defaults[f.name]).cast(f.dataType))
        elif isinstance(f.dataType, T.StringType):
            out[f.name] = F.coalesce(F.col(f"`{f.name}`"), F.lit(""))
        elif isinstance(f.dataType, T.NumericType):
            out[f.name] = F.coalesce(F.col(f"`{f.name}`"), F.lit(0).cast(f.dataType))
    if year_column:
        text = F.coalesce(F.col(f"`{year_column}`").cast("string"), F.lit(""))
        out[f"{year_column}_init"] = F.when(text.isin("", "0"), F.lit("")).otherwise(text)
    return df.withColumns(out)
