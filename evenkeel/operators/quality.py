"""Data-quality rules over rows, counted checks and threshold alerts."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from evenkeel.functions.equality import trim_blanks
from evenkeel.operators.skew import lookup_join

MIB = 1024 * 1024

# Targets that mean every disk, names of the system disk, and how it shows up.
ALL_DISKS = ("", "all", "semua")
ROOT_NAMES = ("root", "sda", "vda")
ROOT_FILESYSTEMS = ("vda2", "sda2")
ROOT_OVERLAY = "overlay"


@dataclass(frozen=True)
class RowRule:
    """A check on one column. Lengths apply to text, ``min``/``max`` to numbers."""

    name: str
    type: str = "string"
    required: bool = False
    default: str | None = None
    transform: str | None = None
    min_length: int | None = None
    max_length: int | None = None
    min: float | None = None
    max: float | None = None
    pattern: str | None = None
    allowed: Sequence[str] = ()
    message: str | None = None


def _parsed(text: Column, kind: str) -> Column:
    clean = trim_blanks(text)
    if kind == "integer":
        return F.when(clean.rlike(r"^[+-]?\d+$"), clean.try_cast("int"))
    if kind == "number":
        return clean.try_cast("double")
    if kind == "boolean":
        return F.when(F.lower(clean).isin("true", "1"), F.lit(True)).when(F.lower(clean).isin("false", "0"), F.lit(False))
    if kind == "date":
        return F.when(clean.rlike(r"^\d{4}-\d{2}-\d{2}$"), clean.try_cast("date"))
    return text


def _check(rule: RowRule, col: Column) -> tuple[Column, list[Column]]:
    kind = (rule.type or "string").lower()
    text = col.cast("string")
    for word, change in (("trim", trim_blanks), ("upper", F.upper), ("lower", F.lower)):
        if word in (rule.transform or "").lower():
            text = change(text)
    blank = F.coalesce(trim_blanks(text) == "", F.lit(True))
    value = _parsed(text, kind)
    fallback = rule.default if rule.default and rule.default.strip() else None
    result = F.when(blank, _parsed(F.lit(fallback).cast("string"), kind)).otherwise(value)
    typed = ~blank & value.isNotNull()

    def error(when: Column, text_: str) -> Column:
        return F.when(when, F.lit(rule.message if rule.message and rule.message.strip() else text_))

    errors = []
    if rule.required:
        errors.append(error(blank, f"{rule.name} is required"))
    if kind in ("integer", "number", "boolean", "date"):
        errors.append(error(~blank & value.isNull(), f"{rule.name} is not a valid {kind}"))
    if kind in ("integer", "number"):
        if rule.min is not None:
            errors.append(error(typed & (value < rule.min), f"{rule.name} is below {rule.min:g}"))
        if rule.max is not None:
            errors.append(error(typed & (value > rule.max), f"{rule.name} is above {rule.max:g}"))
    elif kind not in ("boolean", "date"):
        if rule.min_length is not None:
            errors.append(error(typed & (F.length(text) < rule.min_length),
                                f"{rule.name} is shorter than {rule.min_length}"))
        if rule.max_length is not None:
            errors.append(error(typed & (F.length(text) > rule.max_length),
                                f"{rule.name} is longer than {rule.max_length}"))
    if rule.pattern and rule.pattern.strip():
        errors.append(error(typed & ~text.rlike(rf"\A(?:{rule.pattern})\z"), f"{rule.name} has the wrong format"))
    if rule.allowed:
        choices = sorted({a.strip().lower() for a in rule.allowed if a is not None})
        errors.append(error(typed & ~F.lower(trim_blanks(text)).isin(choices),
                            f"{rule.name} must be one of [{', '.join(rule.allowed)}]"))
    return result, errors


def validate_rows(df: DataFrame, rules: Iterable[RowRule], errors: str = "errors") -> DataFrame:
    """Apply the rules to every row: columns take their transformed, typed value, and
    ``errors`` lists what failed, in rule order. A value of the wrong type reads as null."""
    out, found = {}, []
    for rule in rules:
        source = F.col(f"`{rule.name}`") if rule.name in df.columns else F.lit(None).cast("string")
        out[rule.name], problems = _check(rule, source)
        found.extend(problems)
    collected = F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")
    return df.withColumns({**out, errors: collected})


def split_valid(checked: DataFrame, errors: str = "errors") -> tuple[DataFrame, DataFrame]:
    """The rows without errors, and the rows with them."""
    return checked.filter(F.size(errors) == 0).drop(errors), checked.filter(F.size(errors) > 0)


def assert_counts(spark: SparkSession, rules: Sequence[Mapping[str, str]]) -> DataFrame:
    """Run named checks ``{name, sql, expect, message}`` with expect EQ_0, GT_0 or EQ_1.

    ``sql`` gives one number, or rows to be counted by wrapping it in a count. One
    row per rule: name, count, passed, message.
    """
    tests = {"EQ_0": lambda c: c == 0, "GT_0": lambda c: c > 0, "EQ_1": lambda c: c == 1}
    parts = []
    for i, rule in enumerate(rules):
        expect = rule.get("expect", "EQ_0").upper()
        if expect not in tests:
            raise ValueError(f"unknown expectation: {expect}")
        value = spark.sql(rule["sql"])
        value = value.select(F.col(f"`{value.columns[0]}`").cast("long").alias("row_count"))
        passed = tests[expect](F.col("row_count"))
        parts.append(value.select(
            F.lit(i).alias("position"), F.lit(rule["name"]).alias("name"), "row_count", passed.alias("passed"),
            F.when(~passed, F.lit(rule.get("message") or f"{rule['name']} failed")).alias("message")))
    return reduce(DataFrame.unionByName, parts)


def first_failure(spark: SparkSession, rules: Sequence[Mapping[str, str]]) -> str | None:
    """Check the rules one by one and give the message of the first that fails."""
    for rule in rules:
        row = assert_counts(spark, [rule]).first()
        if not row["passed"]:
            return row["message"]
    return None


def slot_alerts(slots: DataFrame, threshold_mb: int) -> DataFrame:
    """Slots whose retained log reaches the threshold, or is over 10 MiB while inactive."""
    size = F.col("wal_bytes")
    return slots.filter((size >= threshold_mb * MIB) | (~F.col("active") & (size > 10 * MIB)))


def memory_alerts(metrics: DataFrame, limit: float, column: str = "ram_percent") -> DataFrame:
    """Readings whose memory use reaches the limit."""
    return metrics.filter(F.col(column) >= limit)


def threshold_alerts(metrics: DataFrame, rules: Sequence[Mapping], by: Sequence[str] = ("host",)) -> DataFrame:
    """Usage readings at or over a limit.

    Rules are ``{rule, target, limit}`` over ``filesystem``, ``mount`` and
    ``usage_percent``. A blank target or ``all`` means every disk, a name of the
    system disk means the root one; a target that matches no disk of a host falls
    back to all disks of that host.
    """
    def matches(rule) -> Column:
        target = (rule.get("target") or "").strip().lower()
        if target in ALL_DISKS:
            return F.lit(True)
        test = F.lower("filesystem").contains(target) | F.lower("mount").contains(target)
        if target == "/" or any(name in target for name in ROOT_NAMES):
            system = (F.col("mount") == "/") | (F.col("filesystem") == ROOT_OVERLAY)
            for name in ROOT_FILESYSTEMS:
                system = system | F.col("filesystem").contains(name)
            test = test | system
        return test

    named = metrics.select("*", *[F.coalesce(matches(r), F.lit(False)).alias(f"__m{i}") for i, r in enumerate(rules)])
    seen = named.groupBy(*by).agg(*[F.max(f"__m{i}").alias(f"__any{i}") for i in range(len(rules))])
    joined = lookup_join(named, seen, list(by), "left")
    fired = [
        F.when((F.col("usage_percent") >= rule["limit"]) & (F.col(f"__m{i}") | ~F.col(f"__any{i}")),
               F.lit(rule["rule"]))
        for i, rule in enumerate(rules)
    ]
    return joined.select(*metrics.columns, F.explode(F.array_compact(F.array(*fired))).alias("rule"))
