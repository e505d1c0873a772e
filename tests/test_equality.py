import datetime
import decimal

import pytest
from pyspark.sql import functions as F

from evenkeel.functions.equality import norm_eq

D = decimal.Decimal
NAN, INF = float("nan"), float("inf")

CASES = [
    # type a, type b, a, b, equal
    ("string", "string", None, None, True),
    ("string", "string", None, "", False),
    ("string", "string", "", "", True),
    ("string", "string", " Abc\t", "aBC", True),
    ("string", "string", "\u0001x", "x\u0000", True),
    ("string", "string", "1.0", "1", False),            # two texts are never read as numbers
    ("string", "string", "2024-01-01 10:00:00", "2024-01-01 10:00:00.0", False),
    ("int", "bigint", 5, 5, True),
    ("int", "int", 5, 6, False),
    ("int", "int", None, 0, False),
    ("double", "double", 1.0, 1.0 + 5e-10, True),
    ("double", "double", 1.0, 1.0 + 2e-9, False),
    ("double", "double", NAN, NAN, True),
    ("double", "double", NAN, 1.0, False),
    ("double", "double", INF, INF, True),
    ("double", "double", INF, -INF, False),
    ("double", "int", 3.0, 3, True),
    ("float", "double", 0.1, 0.1, True),                # prints the same digits
    ("float", "double", 0.25, 0.26, False),
    ("decimal(10,2)", "double", D("1.50"), 1.5, True),
    ("decimal(10,2)", "decimal(12,4)", D("1.50"), D("1.5000"), True),
    ("bigint", "bigint", 2 ** 53, 2 ** 53 + 1, True),   # as doubles
    ("boolean", "boolean", True, True, True),
    ("boolean", "boolean", True, False, False),
    ("boolean", "int", True, 1, True),
    ("boolean", "int", True, 2, False),
    ("boolean", "int", False, 0, True),
    ("int", "boolean", 0, True, False),
    ("boolean", "double", True, 1.9, True),
    ("boolean", "double", False, 0.5, True),
    ("boolean", "string", True, "TRUE ", True),
    ("int", "string", 7, " 7 ", True),
    ("double", "string", 5.0, "5", True),
    ("double", "string", 5.5, "5.50", True),
    ("int", "string", 5, "5.1", False),
    ("int", "string", -3, "-03.0", True),
    ("int", "string", 0, "-0", True),
    ("decimal(30,2)", "string", D("1234567890123456789012345678.10"), "1234567890123456789012345678.1", True),
    ("decimal(30,2)", "string", D("1234567890123456789012345678.10"), "1234567890123456789012345678.2", False),
    ("double", "string", 1e10, "10000000000", True),
    ("int", "string", 5, "abc", False),
    ("int", "string", 5, "-", False),
    ("date", "date", datetime.date(2024, 1, 2), datetime.date(2024, 1, 2), True),
    ("date", "timestamp_ntz", datetime.date(2024, 1, 2), datetime.datetime(2024, 1, 2), False),
    ("timestamp_ntz", "timestamp_ntz", datetime.datetime(2024, 1, 2, 3, 4, 5, 900000),
     datetime.datetime(2024, 1, 2, 3, 4, 5), True),     # seconds only
    ("timestamp_ntz", "timestamp_ntz", datetime.datetime(2024, 1, 2, 3, 4, 5), datetime.datetime(2024, 1, 2, 3, 4, 6), False),
    ("timestamp_ntz", "string", datetime.datetime(2024, 1, 2, 3, 4, 5, 900000), "2024-01-02 03:04:05", True),
    ("binary", "binary", bytearray(b"abc"), bytearray(b"xyz"), True),     # length only
    ("binary", "binary", bytearray(b"abc"), bytearray(b"abcd"), False),
    ("array<int>", "string", [1, 2], "[1,2]", True),
    ("map<string,int>", "map<string,int>", {"a": 1}, {"a": 2}, False),
]


@pytest.mark.parametrize("case", CASES, ids=lambda c: f"{c[0]}={c[2]!r}|{c[1]}={c[3]!r}"[:60])
def test_cases(spark, case):
    ta, tb, a, b, want = case
    df = spark.createDataFrame([(a, b)], f"a {ta}, b {tb}")
    types = {f.name: f.dataType for f in df.schema.fields}
    row = df.select(norm_eq(F.col("a"), F.col("b"), types["a"], types["b"]).alias("ab"),
                    norm_eq(F.col("b"), F.col("a"), types["b"], types["a"]).alias("ba")).first()
    assert (row["ab"], row["ba"]) == (want, want)


def test_exact_numbers(spark):
    df = spark.createDataFrame([(2 ** 53, 2 ** 53 + 1)], "a long, b long")
    t = df.schema["a"].dataType
    assert df.select(norm_eq(F.col("a"), F.col("b"), t, t, numeric="exact")).first()[0] is False


@pytest.mark.parametrize("text, number, same", [
    ("1e0", "1.00000000000000000001", False), ("1e0", "1.00000000000000000000", True), ("-2.50E+1", "-25", True), ("0e9", "-0.0", True),
    ("1e-20", "0.00000000000000000001", True), ("+5", "5", False), ("12345678901234567890.5", "12345678901234567890.50", True), (".5", "0.5", True)])
def test_number_texts_compare_by_digits(spark, text, number, same):
    row = spark.sql(f"SELECT '{text}' AS a, CAST('{number}' AS DECIMAL(38,20 )) AS b" if len(number) < 30 and "1234567890" not in number
                    else f"SELECT '{text}' AS a, CAST('{number}' AS DECIMAL(38,2)) AS b")
    types = {f.name: f.dataType for f in row.schema.fields}
    assert row.select(norm_eq(F.col("a"), F.col("b"), types["a"], types["b"])).first()[0] is same
