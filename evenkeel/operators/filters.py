"""Row filters built from data: filter lists, ranges, searches, address rules."""

from __future__ import annotations

import datetime
import re
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from evenkeel.functions.json import let

# Accepted field names and operators.
FIELD_NAME = re.compile(r"[a-zA-Z_][a-zA-Z0-9_.]*")
OPERATORS = ("=", "!=", "<>", "<", ">", "<=", ">=", "LIKE", "NOT LIKE", "ILIKE", "NOT ILIKE",
             "IN", "NOT IN", "IS NULL", "IS NOT NULL")
LOCALHOST = ("127.0.0.1", "localhost", "::1")
LOOPBACK_V6 = ("0:0:0:0:0:0:0:1", "::1")
V4_IN_V6 = "::ffff:"


def _one_filter(field: str, op: str, value) -> Column:
    col = F.col(".".join(f"`{part}`" for part in field.split(".")))
    if op == "IS NULL":
        return col.isNull()
    if op == "IS NOT NULL":
        return col.isNotNull()
    if op in ("IN", "NOT IN"):
        if isinstance(value, (list, tuple)):
            items = list(value)
        else:
            items = [] if value is None else [part.strip() for part in str(value).split(",")]
        if not items:
            return F.lit(op == "NOT IN")
        return col.isin(items) if op == "IN" else ~col.isin(items)
    text = F.lit(None if value is None else str(value))
    tests = {
        "=": lambda: col == text, "!=": lambda: col != text, "<>": lambda: col != text,
        "<": lambda: col < text, ">": lambda: col > text, "<=": lambda: col <= text, ">=": lambda: col >= text,
        "LIKE": lambda: F.like(col, text), "NOT LIKE": lambda: ~F.like(col, text),
        "ILIKE": lambda: F.ilike(col, text), "NOT ILIKE": lambda: ~F.ilike(col, text),
    }
    return tests[op]()


def structured_filter(df: DataFrame, filters: Iterable[Mapping] | None) -> DataFrame:
    """AND of ``{field, op, value}`` items; items without field or operator are skipped.

    Values become literals, never text of the query, so the scan sees them as
    pushed filters. An empty IN keeps nothing, an empty NOT IN keeps everything.
    """
    conditions = []
    for item in filters or ():
        field, op = item.get("field"), item.get("op")
        if field is None or op is None:
            continue
        field, op = str(field).strip(), str(op).strip().upper()
        if not FIELD_NAME.fullmatch(field):
            raise ValueError(f"invalid field name: {field!r}")
        if op not in OPERATORS:
            raise ValueError(f"invalid operator: {op!r}")
        conditions.append(_one_filter(field, op, item.get("value")))
    return df.filter(reduce(lambda a, b: a & b, conditions)) if conditions else df


def _is_date(text) -> bool:
    """Whether the whole text is a date, or a date and a time of day."""
    try:
        datetime.datetime.fromisoformat(str(text).strip())
        return True
    except ValueError:
        return False


def range_query(df: DataFrame, date_column: str | None = None, start=None, end=None,
                extra_where: str | None = None, limit: int | None = None) -> DataFrame:
    """Rows with ``start <= date_column <= end`` and an extra condition, up to ``limit``.

    An unsafe column name or a value that is no date is ignored. A plain date as the end of a
    range over timestamps takes in all of that day.
    """
    if date_column and FIELD_NAME.fullmatch(date_column):
        dtype = df.schema[date_column].dataType
        if start and _is_date(start):
            df = df.filter(F.col(date_column) >= F.lit(str(start).strip()).cast(dtype))
        if end and _is_date(end):
            last = str(end).strip()
            if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)) and len(last) == 10:
                df = df.filter(F.col(date_column) < F.date_add(F.lit(last).cast("date"), 1).cast(dtype))
            else:
                df = df.filter(F.col(date_column) <= F.lit(last).cast(dtype))
    if extra_where and extra_where.strip():
        df = df.filter(F.expr(extra_where))
    return df.limit(limit) if limit else df


def simple_select(df: DataFrame, columns: Sequence[str] = (), distinct: bool = False, where: str | None = None,
                  order: Sequence[str] = (), limit: int | None = None, page: int = 1) -> DataFrame:
    """Columns or all, optional distinct, condition, order and page; nulls read as empty text."""
    if where:
        df = df.filter(F.expr(where))
    if columns:
        df = df.select(*columns)
    if distinct:
        df = df.distinct()
    if order:
        df = df.orderBy(*[F.expr(o[:-5]).desc() if o.lower().endswith(" desc") else F.expr(o) for o in order])
    if limit:
        df = df.offset((max(page, 1) - 1) * limit).limit(limit)
    return df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns])


def search_any(df: DataFrame, term: str | None) -> DataFrame:
    """Rows where any column contains the term, ignoring case; a blank term keeps all."""
    needle = (term or "").strip().lower()
    if not needle:
        return df
    tests = [F.coalesce(F.lower(F.col(f"`{c}`").cast("string")).contains(needle), F.lit(False)) for c in df.columns]
    return df.filter(reduce(lambda a, b: a | b, tests))


def _plain_address(ip: str) -> str:
    text = ip.strip()
    if text in LOOPBACK_V6:
        return "127.0.0.1"
    return text.removeprefix(V4_IN_V6)


def _ipv4_number(text: str) -> int | None:
    parts = text.split(".")
    if len(parts) != 4 or not all(p.isdigit() and int(p) <= 255 for p in parts):
        return None
    return reduce(lambda n, p: n * 256 + int(p), parts, 0)


def ip_allowed(ip: Column, rules: str | Sequence[str] | None) -> Column:
    """Whether an address meets one of the rules: exact, ``a.b.c.*``, CIDR, localhost names, ``*``.

    The rules are read once into literals, so the test is one expression per row.
    """
    if isinstance(rules, str):
        rules = re.split(r"[,;\r\n]+", rules)
    rules = [r.strip() for r in rules or () if r and r.strip()]
    if not rules or "*" in rules or "0.0.0.0/0" in rules:
        return F.lit(True)
    address = F.trim(F.coalesce(ip, F.lit("127.0.0.1")))  # an unknown client counts as local
    address = F.when(address.isin(*LOOPBACK_V6), F.lit("127.0.0.1")) \
        .otherwise(F.regexp_replace(address, f"^{V4_IN_V6}", ""))
    exact = sorted({_plain_address(r).lower() for r in rules})
    if any(name in LOCALHOST for name in exact):
        exact = sorted({*exact, *LOCALHOST})
    prefixes, ranges = [], []
    for rule in rules:
        if rule.endswith(".*"):
            prefixes.append(rule[:-1])
        base, slash, bits = rule.partition("/")
        start = _ipv4_number(base.strip())
        if slash and start is not None and bits.strip().isdigit() and int(bits) <= 32:
            span = 1 << (32 - int(bits))
            ranges.append((start // span * span, start // span * span + span - 1))
    test = F.lower(address).isin(exact)
    for prefix in prefixes:
        test = test | address.startswith(prefix)
    if ranges:
        def in_ranges(number: Column) -> Column:
            hits = [number.between(low, high) for low, high in ranges]
            return F.coalesce(reduce(lambda a, b: a | b, hits), F.lit(False))

        test = test | let(address, lambda text: let(_address_number(text), in_ranges))
    return test


def _address_number(address: Column) -> Column:
    """An IPv4 address as a number; null if it is none."""
    def number(parts: Column) -> Column:
        octets = [F.when(F.length(F.get(parts, F.lit(i))) <= 3, F.get(parts, F.lit(i)).try_cast("long")) for i in range(4)]
        inside = reduce(lambda a, b: a & b, [o.between(0, 255) for o in octets])
        total = reduce(lambda sum_, octet: sum_ * 256 + octet, octets)
        return F.when((F.size(parts) == 4) & inside, total)

    return let(F.split(address, r"\."), number)


def ip_allowlist(events: DataFrame, rules: str | Sequence[str] | None, column: str = "client_ip") -> DataFrame:
    """Keep events from allowed addresses; no rules allow all."""
    return events.filter(ip_allowed(F.col(column), rules))


def filter_keep_deletes(df: DataFrame, condition: Column | str, flag: str = "is_deleted") -> DataFrame:
    """Filter without hiding delete records, so that a delete still reaches the target."""
    condition = F.expr(condition) if isinstance(condition, str) else condition
    return df.filter(F.col(flag).cast("boolean") | condition)


def pk_not_null(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Drop rows without a key. For the driving table only: on a joined table it would
    turn a left join into an inner one."""
    return df.dropna(subset=list(keys))
