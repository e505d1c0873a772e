"""Every registered query against its SQL on the smallest tables."""

import os
import sys

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.join(ROOT, "tools"))

import __spark_entry__ as entry  # noqa: E402
from check import compare  # noqa: E402
from evenkeel.plans.base import TABLES  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
# Queries whose filter keeps nothing on the smallest tables.
MAY_BE_EMPTY = set()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for table in TABLES:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query_matches_sql(spark, con, name):
    if name not in entry.oracle_sql():
        pytest.skip("no SQL; held against brute force elsewhere")
    text, _, ok = compare(spark, con, name, FOLDER)
    assert ok or (name in MAY_BE_EMPTY and text.startswith("no rows")), text


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
