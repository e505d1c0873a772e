"""Cell equality across column types, as plain Column expressions.

The branch is chosen from the two column types on the driver, so each compared
column costs one short expression inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

# Comparison tolerance, and the characters a trim removes (all up to U+0020).
TOLERANCE = 1e-9
BLANKS = "".join(chr(code) for code in range(0x21))

# A number as text: whole digits, digits behind the point, exponent.
NUMBER_TEXT = r"^-?(?=\.?\d)(\d*)\.?(\d*)(?:[eE]([+-]?\d+))?$"

_TEMPORAL = (T.TimestampType, T.TimestampNTZType)
_NESTED = (T.StructType, T.ArrayType, T.MapType, T.VariantType)


def is_nested(dtype: T.DataType) -> bool:
    return isinstance(dtype, _NESTED)


def trim_blanks(col: Column) -> Column:
    return F.btrim(col, F.lit(BLANKS))


def as_read(col: Column, dtype: T.DataType) -> Column:
    """The value as a reader sees it: temporal, binary and nested values become text."""
    if isinstance(dtype, T.TimestampNTZType):
        return F.substring_index(col.cast("string"), ".", 1)  # no detour through the session zone
    if isinstance(dtype, T.TimestampType):
        return F.date_format(col, "yyyy-MM-dd HH:mm:ss")
    if isinstance(dtype, T.DateType):
        return col.cast("string")
    if isinstance(dtype, T.BinaryType):
        return F.when(
            col.isNotNull(),
            F.concat(F.lit("[BINARY Data: "), F.octet_length(col).cast("string"), F.lit(" bytes]")),
        )
    if is_nested(dtype):
        return F.to_json(col)
    return col


def cell_text(col: Column, dtype: T.DataType) -> Column:
    """The value as display text; null stays null."""
    return as_read(col, dtype).cast("string")


def key_text(col: Column, dtype: T.DataType) -> Column:
    """Keys match on exact text; nested values use their JSON form."""
    return F.to_json(col) if is_nested(dtype) else col.cast("string")


def same_text(a: Column, b: Column) -> Column:
    return (a == b) | (F.lower(trim_blanks(a)) == F.lower(trim_blanks(b)))


def _close(a: Column, b: Column) -> Column:
    x, y = a.cast("double"), b.cast("double")
    return (x == y) | (F.abs(x - y) < F.lit(TOLERANCE))


def _same_number(a: Column, b: Column, ta: T.DataType, tb: T.DataType, numeric: str) -> Column:
    small = (T.ByteType, T.ShortType, T.IntegerType)
    if isinstance(ta, small) and isinstance(tb, small):
        return a == b
    if numeric == "exact" and not isinstance(ta, (T.FloatType, T.DoubleType)) \
            and not isinstance(tb, (T.FloatType, T.DoubleType)):
        return a == b
    result = _close(a, b)
    # A 32-bit float also equals a wider number that prints the same digits.
    if isinstance(ta, T.FloatType) != isinstance(tb, T.FloatType):
        x = a.cast("string").cast("double") if isinstance(ta, T.FloatType) else a.cast("double")
        y = b.cast("string").cast("double") if isinstance(tb, T.FloatType) else b.cast("double")
        result = result | (x == y)
    return result


def _digits(text: Column) -> tuple[Column, Column]:
    """Canonical significant digits (signed, empty for zero) and the place of the point before them.

    ``0.digits * 10 ** place`` is the number, so two texts are one number if both agree,
    whatever their length and exponent.
    """
    part = lambda i: F.regexp_extract(text, NUMBER_TEXT, i)
    whole, digits = part(1), F.concat(part(1), part(2))
    power = F.coalesce(F.nullif(part(3), F.lit("")).try_cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)"))
    bare = F.regexp_replace(digits, "^0+", "")
    place = F.length(whole) - (F.length(digits) - F.length(bare)) + power
    held = F.regexp_replace(bare, "0+$", "")
    signed = F.when(text.startswith("-") & (held != ""), F.concat(F.lit("-"), held)).otherwise(held)
    return signed, F.when(held == "", F.lit(0).cast("decimal(38,0)")).otherwise(place)


def _same_numeric_text(a: Column, b: Column) -> Column:
    (x, at), (y, bt) = _digits(a), _digits(b)
    return a.rlike(NUMBER_TEXT) & b.rlike(NUMBER_TEXT) & (x == y) & (at == bt)


def _truth_of_number(flag: Column, number: Column) -> Column:
    x = number.cast("double")
    return F.when(flag, (x >= 1) & (x < 2)).otherwise((x > -1) & (x < 1))


def norm_eq(a: Column, b: Column, type_a: T.DataType, type_b: T.DataType, numeric: str = "double") -> Column:
    """True when two cells count as equal; never null.

    Null equals only null (and differs from an empty text). Numbers compare as
    doubles within 1e-9 (``numeric="exact"`` keeps integers and decimals exact),
    texts trimmed and ignoring case, booleans against 1/0, and other mixed types
    as text with a numeric second try.
    """
    if isinstance(type_a, T.NullType) or isinstance(type_b, T.NullType):
        return a.isNull() & b.isNull()
    num_a, num_b = isinstance(type_a, T.NumericType), isinstance(type_b, T.NumericType)
    bool_a, bool_b = isinstance(type_a, T.BooleanType), isinstance(type_b, T.BooleanType)
    if num_a and num_b:
        core = _same_number(a, b, type_a, type_b, numeric)
    elif bool_a and bool_b:
        core = a == b
    elif bool_a and num_b:
        core = _truth_of_number(a, b)
    elif num_a and bool_b:
        core = _truth_of_number(b, a)
    elif type_a == type_b and isinstance(type_a, _TEMPORAL):
        core = (a == b) | (as_read(a, type_a) == as_read(b, type_b))
    elif isinstance(type_a, T.DateType) and isinstance(type_b, T.DateType):
        core = a == b
    elif isinstance(type_a, T.BinaryType) and isinstance(type_b, T.BinaryType):
        core = F.octet_length(a) == F.octet_length(b)
    else:
        x, y = cell_text(a, type_a), cell_text(b, type_b)
        core = same_text(x, y)
        mixed = num_a or num_b or bool_a or bool_b
        if mixed:
            core = core | _same_numeric_text(trim_blanks(x), trim_blanks(y))
    return F.coalesce(core, a.isNull() & b.isNull())
