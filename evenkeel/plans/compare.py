"""Comparison queries: rows, cells, totals, sync plans, many tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from evenkeel.functions.equality import norm_eq
from evenkeel.operators import diff as d
from evenkeel.operators import ranking, schema, versioned
from evenkeel.operators.tree_diff import tree_diff
from evenkeel.plans.base import Tables, query
from evenkeel.sources import snapshots
from evenkeel.sources.manifests import BucketTable

# A changed copy of orders: case only, price, tiny price, null priority; rows missing and rows added.
ORDERS_COPY = """
SELECT o_orderkey, o_custkey,
       CASE WHEN o_orderkey % 41 = 0 THEN lower(o_orderstatus) ELSE o_orderstatus END AS o_orderstatus,
       CASE WHEN o_orderkey % 37 = 0 THEN o_totalprice + 1
            WHEN o_orderkey % 43 = 0 THEN o_totalprice + 1e-10 ELSE o_totalprice END AS o_totalprice,
       o_orderdate,
       CASE WHEN o_orderkey % 47 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority
FROM {orders} WHERE o_orderkey % 50 <> 0
UNION ALL
SELECT o_orderkey + 100000000, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
FROM {orders} WHERE o_orderkey % 60 = 0
"""

ORDER_KEY = d.DiffSpec(keys=["o_orderkey"])
ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]

_TEXT = "lower(trim({a})) IS NOT DISTINCT FROM lower(trim({b}))"
_NUMBER = "(({a} IS NULL AND {b} IS NULL) OR coalesce(abs({a} - {b}) < 1e-9, false))"
_SECONDS = "date_trunc('second', {a}) IS NOT DISTINCT FROM date_trunc('second', {b})"


def _same(column: str, form: str) -> str:
    return form.format(a=f"s.{column}", b=f"t.{column}")


ORDERS_SAME = " AND ".join([
    _same("o_custkey", _NUMBER), _same("o_orderstatus", _TEXT), _same("o_totalprice", _NUMBER),
    _same("o_orderdate", _SECONDS), _same("o_orderpriority", _TEXT)])

# The joined pair with its status, for the checks below.
ORDERS_DIFF = f"""
copy AS ({ORDERS_COPY}),
pair AS (
  SELECT coalesce(s.o_orderkey, t.o_orderkey) AS k, {', '.join(f's.{c} AS s_{c}, t.{c} AS t_{c}' for c in ORDER_COLUMNS)},
         CASE WHEN t.o_orderkey IS NULL THEN 'SOURCE_ONLY' WHEN s.o_orderkey IS NULL THEN 'TARGET_ONLY'
              WHEN {ORDERS_SAME} THEN 'MATCH' ELSE 'DIFFERENT' END AS status
  FROM {{orders}} s FULL OUTER JOIN copy t ON s.o_orderkey = t.o_orderkey)
"""
_STAMP = "strftime({c}, '%Y-%m-%d %H:%M:%S')"


def orders_diff(t: Tables, **change):
    return d.row_diff(t.orders, t.sql(ORDERS_COPY), replace(ORDER_KEY, **change))


def _dates_as_text(df):
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("s_o_orderdate", "t_o_orderdate")})


_DIFF_ROW = ", ".join(
    f"{_STAMP.format(c=f'{side}_{c}')} AS {side}_{c}" if c == "o_orderdate" else f"{side}_{c}"
    for c in ORDER_COLUMNS for side in ("s", "t"))


@query("row_diff_orders", f"WITH {ORDERS_DIFF} SELECT CAST(k AS VARCHAR) AS row_key, status, {_DIFF_ROW} FROM pair")
def row_diff_orders(t: Tables):
    return _dates_as_text(orders_diff(t))


@query("row_diff_unique_keys", f"""WITH {ORDERS_DIFF}
SELECT CAST(k AS VARCHAR) AS row_key, status, {_DIFF_ROW} FROM pair WHERE status <> 'MATCH'""")
def row_diff_unique_keys(t: Tables):
    return _dates_as_text(orders_diff(t, unique_keys=True, return_matched=False))


@query("tree_diff_orders", f"""WITH {ORDERS_DIFF}
SELECT CAST(k AS VARCHAR) AS row_key, status, {_DIFF_ROW} FROM pair WHERE status <> 'MATCH'""")
def tree_diff_orders(t: Tables):
    return _dates_as_text(tree_diff(t.orders, t.sql(ORDERS_COPY), replace(ORDER_KEY, unique_keys=True)).diff)


# A copy in which one stretch of keys was changed, lost and gained rows.
_STRETCH = """
SELECT * REPLACE (CASE WHEN o_orderkey BETWEEN 700 AND 1000 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice)
FROM {orders} WHERE o_orderkey NOT BETWEEN 1001 AND 1100"""


@query("tree_diff_stretch", f"""
SELECT CAST(o_orderkey AS VARCHAR) AS row_key, CASE WHEN o_orderkey <= 1000 THEN 'DIFFERENT' ELSE 'SOURCE_ONLY' END AS status,
  o_totalprice AS s_o_totalprice, c.price AS t_o_totalprice
FROM {{orders}} LEFT JOIN (SELECT o_orderkey AS k, o_totalprice AS price FROM ({_STRETCH})) c ON k = o_orderkey
WHERE o_orderkey BETWEEN 700 AND 1100""")
def tree_diff_stretch(t: Tables):
    moved = t.orders.filter("o_orderkey NOT BETWEEN 1001 AND 1100").withColumn("o_totalprice", F.when(
        F.col("o_orderkey").between(700, 1000), F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    found = tree_diff(t.orders, moved, replace(ORDER_KEY, unique_keys=True))
    return found.diff.select("row_key", "status", "s_o_totalprice", "t_o_totalprice")


@query("row_diff_text_keys", f"WITH {ORDERS_DIFF} SELECT CAST(k AS VARCHAR) AS row_key, status FROM pair")
def row_diff_text_keys(t: Tables):
    copy = t.sql(ORDERS_COPY).withColumn("O_ORDERKEY", F.col("o_orderkey").cast("string"))
    return d.row_diff(t.orders, copy, ORDER_KEY).select("row_key", "status")


_CELL = {"o_orderkey": "CAST({c} AS VARCHAR)", "o_custkey": "CAST({c} AS VARCHAR)", "o_orderstatus": "{c}",
         "o_totalprice": "CAST({c} AS VARCHAR)", "o_orderdate": _STAMP, "o_orderpriority": "{c}"}
_CELL_SAME = {"o_orderkey": "true", "o_custkey": _NUMBER, "o_orderstatus": _TEXT, "o_totalprice": _NUMBER,
              "o_orderdate": _SECONDS, "o_orderpriority": _TEXT}


def _cells(column: str, table: str = "pair") -> str:
    same = _CELL_SAME[column].format(a=f"s_{column}", b=f"t_{column}")
    return f"""SELECT CAST(k AS VARCHAR) AS row_key, status, '{column}' AS "column",
  {_CELL[column].format(c=f's_{column}')} AS source_value, {_CELL[column].format(c=f't_{column}')} AS target_value,
  status <> 'DIFFERENT' OR NOT ({same}) AS is_different FROM {table} WHERE status <> 'MATCH'"""


@query("cell_diff_orders", f"WITH {ORDERS_DIFF} " + " UNION ALL ".join(_cells(c) for c in ORDER_COLUMNS))
def cell_diff_orders(t: Tables):
    return d.cell_diff(orders_diff(t, return_matched=False))


def _render(column: str) -> str:
    left, right = (_CELL[column].format(c=f"{side}_{column}") for side in "st")
    same = _CELL_SAME[column].format(a=f"s_{column}", b=f"t_{column}")
    return f"""CASE WHEN status IN ('SOURCE_ONLY', 'TARGET_ONLY') OR (status = 'DIFFERENT' AND NOT ({same}))
  THEN '[SRC] ' || coalesce({left}, 'NULL') || chr(10) || '[TGT] ' || coalesce({right}, 'NULL')
  ELSE coalesce({left}, {right}, '') END AS {column}"""


@query("render_cells_orders", f"""WITH {ORDERS_DIFF}
SELECT status, CAST(k AS VARCHAR) AS row_key, {', '.join(_render(c) for c in ORDER_COLUMNS)} FROM pair""")
def render_cells_orders(t: Tables):
    return d.render_cells(orders_diff(t))


_SUMMARY = """count(*) FILTER (WHERE status = 'MATCH') AS match_count,
  count(*) FILTER (WHERE status = 'DIFFERENT') AS different_count,
  count(*) FILTER (WHERE status = 'SOURCE_ONLY') AS source_only_count,
  count(*) FILTER (WHERE status = 'TARGET_ONLY') AS target_only_count,
  count(*) FILTER (WHERE status <> 'MATCH') AS total_differences"""


@query("diff_summary_orders", f"""WITH {ORDERS_DIFF}
SELECT (SELECT count(*) FROM {{orders}}) AS total_source, (SELECT count(*) FROM copy) AS total_target, {_SUMMARY} FROM pair""")
def diff_summary_orders(t: Tables):
    return d.diff_summary(orders_diff(t), t.orders, t.sql(ORDERS_COPY))


@query("status_counts_orders", f"WITH {ORDERS_DIFF} SELECT status, count(*) AS row_count FROM pair GROUP BY status")
def status_counts_orders(t: Tables):
    return d.status_counts(orders_diff(t))


@query("status_filter_orders", f"""WITH {ORDERS_DIFF}
SELECT CAST(k AS VARCHAR) AS row_key, status FROM pair WHERE status = 'SOURCE_ONLY'""")
def status_filter_orders(t: Tables):
    return d.filter_status(orders_diff(t), "source_only").select("row_key", "status")


@query("exclude_columns_orders", f"""WITH {ORDERS_DIFF.replace(' AND ' + _same('o_totalprice', _NUMBER), '')}
SELECT CAST(k AS VARCHAR) AS row_key, status FROM pair""")
def exclude_columns_orders(t: Tables):
    out = orders_diff(t, exclude=[" O_TotalPrice ", ""])
    assert "s_o_totalprice" not in out.columns
    return out.select("row_key", "status")


SUPPLIER_COPY = """
SELECT s_suppkey, s_name, s_nationkey, CASE WHEN s_suppkey % 7 = 0 THEN s_acctbal + 1 ELSE s_acctbal END AS s_acctbal
FROM {supplier}
"""


@query("keyless_diff_supplier", f"""
WITH copy AS ({SUPPLIER_COPY}),
s AS (SELECT DISTINCT * FROM {{supplier}}),
pair AS (SELECT s.s_suppkey AS a, c.s_suppkey AS b FROM s FULL OUTER JOIN copy c
  ON s.s_suppkey = c.s_suppkey AND s.s_name = c.s_name AND s.s_nationkey = c.s_nationkey AND s.s_acctbal = c.s_acctbal)
SELECT a AS s_s_suppkey, b AS t_s_suppkey,
  CASE WHEN b IS NULL THEN 'SOURCE_ONLY' WHEN a IS NULL THEN 'TARGET_ONLY' ELSE 'MATCH' END AS status FROM pair""")
def keyless_diff_supplier(t: Tables):
    return d.row_diff(t.supplier, t.sql(SUPPLIER_COPY), d.DiffSpec()).select("s_s_suppkey", "t_s_suppkey", "status")


@query("duplicate_keys_lineitem", """
SELECT l_orderkey, l_linenumber, count(*) AS row_count FROM {lineitem}
GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""")
def duplicate_keys_lineitem(t: Tables):
    return d.duplicate_report(t.lineitem, ["l_orderkey", "l_linenumber"])


_LINE_ORDER = """l_orderkey DESC, l_partkey DESC, l_suppkey DESC, l_linenumber DESC, l_quantity DESC,
  l_extendedprice DESC, l_discount DESC, l_tax DESC, l_returnflag DESC, l_linestatus DESC, l_shipdate DESC"""
_LINE_LAST = f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
  ORDER BY l_shipdate DESC, {_LINE_ORDER}) AS rn FROM {{lineitem}}) WHERE rn = 1"""


@query("dedupe_last_lineitem", f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM ({_LINE_LAST})""")
def dedupe_last_lineitem(t: Tables):
    return d.dedupe_last(t.lineitem, ["l_orderkey", "l_linenumber"], ["l_shipdate"]).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


LINE_COPY = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       CASE WHEN l_partkey % 11 = 0 THEN l_quantity + 1 ELSE l_quantity END AS l_quantity,
       l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate
FROM {lineitem} WHERE l_orderkey % 13 <> 0
"""
_LINE_VALUES = ("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("duplicate_keys_diff_lineitem", f"""
WITH copy AS ({LINE_COPY}), s AS ({_LINE_LAST}),
pair AS (SELECT CASE WHEN t.l_orderkey IS NULL THEN 'SOURCE_ONLY' WHEN s.l_orderkey IS NULL THEN 'TARGET_ONLY'
  WHEN {' AND '.join(f'abs(s.{c} - t.{c}) < 1e-9' for c in _LINE_VALUES)} AND lower(s.l_returnflag) = lower(t.l_returnflag)
   AND lower(s.l_linestatus) = lower(t.l_linestatus) AND s.l_shipdate = t.l_shipdate
  THEN 'MATCH' ELSE 'DIFFERENT' END AS status
  FROM s FULL OUTER JOIN copy t ON s.l_orderkey = t.l_orderkey AND s.l_linenumber = t.l_linenumber)
SELECT (SELECT count(*) FROM {{lineitem}}) AS total_source, (SELECT count(*) FROM copy) AS total_target, {_SUMMARY} FROM pair""")
def duplicate_keys_diff_lineitem(t: Tables):
    spec = d.DiffSpec(keys=["l_orderkey", "l_linenumber"], sort=["l_shipdate"])
    copy = t.sql(LINE_COPY)
    return d.diff_summary(d.row_diff(t.lineitem, copy, spec), t.lineitem, copy)


# A third of the target rows under one key: they meet the one source row by broadcast.
SKEWED_COPY = """
SELECT CASE WHEN l_partkey % 3 = 0 THEN 7 ELSE l_orderkey END AS o_orderkey, l_quantity AS o_totalprice FROM {lineitem}
"""


@query("hot_key_diff", f"""
WITH t AS ({SKEWED_COPY}), s AS (SELECT o_orderkey, o_totalprice FROM {{orders}}),
pair AS (SELECT s.o_orderkey AS a, t.o_orderkey AS b, s.o_totalprice AS x, t.o_totalprice AS y
  FROM s FULL OUTER JOIN t ON s.o_orderkey = t.o_orderkey)
SELECT coalesce(a, b) AS k, CASE WHEN b IS NULL THEN 'SOURCE_ONLY' WHEN a IS NULL THEN 'TARGET_ONLY'
  WHEN abs(x - y) < 1e-9 THEN 'MATCH' ELSE 'DIFFERENT' END AS status, count(*) AS row_count FROM pair GROUP BY 1, 2""")
def hot_key_diff(t: Tables):
    spec = d.DiffSpec(keys=["o_orderkey"], hot_key_args={"share": 0.01, "min_rows": 1000})
    out = d.row_diff(t.orders.select("o_orderkey", "o_totalprice"), t.sql(SKEWED_COPY), spec)
    return out.select(F.coalesce("s_o_orderkey", "t_o_orderkey").alias("k"), "status") \
        .groupBy("k", "status").agg(F.count(F.lit(1)).alias("row_count"))


@query("source_driven_diff_orders", f"""WITH {ORDERS_DIFF}
SELECT CAST(k AS VARCHAR) AS row_key, status FROM pair
WHERE status <> 'TARGET_ONLY' AND k >= (SELECT max(o_orderkey) / 4 FROM {{orders}})""")
def source_driven_diff_orders(t: Tables):
    top = t.orders.agg(F.max("o_orderkey")).first()[0]
    return d.source_driven_diff(t.orders, t.sql(ORDERS_COPY), ORDER_KEY, lo=top / 4).select("row_key", "status")


@query("count_both_orders", f"""
SELECT (SELECT count(*) FROM {{orders}}) AS source_count, (SELECT count(*) FROM ({ORDERS_COPY})) AS target_count""")
def count_both_orders(t: Tables):
    return d.count_both(t.orders, t.sql(ORDERS_COPY))


@query("row_fingerprint_customer", """
SELECT c_custkey, md5(CAST(c_custkey AS VARCHAR) || '|||' || c_name || '|||' || CAST(c_nationkey AS VARCHAR) || '|||'
  || CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_mktsegment END) AS fingerprint FROM {customer}""")
def row_fingerprint_customer(t: Tables):
    segment = F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment"))
    return t.customer.select("c_custkey", d.row_fingerprint(
        [F.col("c_custkey"), F.col("c_name"), F.col("c_nationkey"), segment]).alias("fingerprint"))


# Which buckets differ depends on the hash; every changed key must lie in one of them.
@query("bucket_checksums_orders", f"""WITH {ORDERS_DIFF}
SELECT count(*) FILTER (WHERE status = 'SOURCE_ONLY') AS source_only_found, CAST(0 AS BIGINT) AS buckets_of_equal_tables FROM pair""")
def bucket_checksums_orders(t: Tables):
    buckets = 4096
    bad = d.differing_buckets(t.orders, t.sql(ORDERS_COPY), ["o_orderkey"], buckets)
    place = F.pmod(F.xxhash64(F.col("row_key")), F.lit(buckets)).cast("int")
    changed = d.filter_status(orders_diff(t), "SOURCE_ONLY").withColumn("bucket", place).join(bad, "bucket", "left_semi")
    none = d.differing_buckets(t.orders, t.orders.select("*"), ["o_orderkey"], buckets)
    zero = F.lit(0).cast("long")
    return changed.agg(F.count(F.lit(1)).alias("source_only_found")).withColumn("buckets_of_equal_tables", zero).unionByName(
        none.agg(F.count(F.lit(1)).alias("buckets_of_equal_tables")).withColumn("source_only_found", zero)).agg(
        F.sum("source_only_found").alias("source_only_found"), F.sum("buckets_of_equal_tables").alias("buckets_of_equal_tables"))


@query("sync_plan_orders", f"""WITH {ORDERS_DIFF}
SELECT CASE status WHEN 'SOURCE_ONLY' THEN 'INSERT' WHEN 'DIFFERENT' THEN 'UPDATE' ELSE 'DELETE' END AS op,
  k AS o_orderkey, s_o_custkey AS o_custkey, s_o_orderstatus AS o_orderstatus, s_o_totalprice AS o_totalprice,
  s_o_orderpriority AS o_orderpriority, {_STAMP.format(c='s_o_orderdate')} AS o_orderdate FROM pair WHERE status <> 'MATCH'""")
def sync_plan_orders(t: Tables):
    plan = versioned.sync_plan(orders_diff(t, return_matched=False), ["o_orderkey"])
    return plan.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))


# After the sync only what counts as equal may still differ from the source.
_SYNCED = f"""WITH {ORDERS_DIFF}
SELECT k AS o_orderkey, CASE WHEN status = 'MATCH' THEN t_o_custkey ELSE s_o_custkey END AS o_custkey,
  CASE WHEN status = 'MATCH' THEN t_o_orderstatus ELSE s_o_orderstatus END AS o_orderstatus,
  CASE WHEN status = 'MATCH' THEN t_o_orderpriority ELSE s_o_orderpriority END AS o_orderpriority,
  CAST(CASE WHEN status = 'MATCH' THEN t_o_totalprice ELSE s_o_totalprice END AS DOUBLE) AS o_totalprice,
  {_STAMP.format(c="CASE WHEN status = 'MATCH' THEN t_o_orderdate ELSE s_o_orderdate END")} AS o_orderdate
FROM pair WHERE status <> 'TARGET_ONLY'"""


@query("apply_sync_orders", _SYNCED)
def apply_sync_orders(t: Tables):
    path = t.scratch("sync")
    snapshots.write_snapshot(t.sql(ORDERS_COPY), path)
    plan = versioned.sync_plan(
        d.row_diff(t.orders, snapshots.read_snapshot(t.spark, path), replace(ORDER_KEY, return_matched=False)),
        ["o_orderkey"])
    versioned.apply_sync(t.spark, path, plan, ["o_orderkey"])
    return snapshots.read_snapshot(t.spark, path).withColumns({
        "o_totalprice": F.col("o_totalprice").cast("double"), "o_orderdate": F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")})


@query("apply_buckets_orders", _SYNCED)
def apply_buckets_orders(t: Tables):
    """The same plan on a table of buckets; only buckets with a key of the plan are rewritten."""
    table = BucketTable(t.spark, t.scratch("buckets"), ["o_orderkey"], buckets=16, version="o_orderdate", sequence=None)
    table.upsert(t.sql(ORDERS_COPY))
    plan = versioned.sync_plan(d.row_diff(t.orders, table.read(), replace(ORDER_KEY, return_matched=False)), ["o_orderkey"])
    table.apply(plan)
    return table.read().withColumns({
        "o_totalprice": F.col("o_totalprice").cast("double"), "o_orderdate": F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")})


@query("sync_null_keys", """
SELECT 'MATCH' AS status, count(*) AS row_count FROM {supplier}""")
def sync_null_keys(t: Tables):
    """A sync of rows with null keys, after which a second comparison finds only matches."""
    path = t.scratch("sync")
    source = t.supplier.select("s_suppkey", F.when(F.col("s_suppkey") % 3 != 0, F.col("s_nationkey")).alias("nation"), "s_name", "s_acctbal")
    target = source.filter("s_suppkey % 4 <> 0").withColumn("s_acctbal", F.when(
        F.col("s_suppkey") % 5 != 0, F.col("s_acctbal"))).unionByName(source.limit(1).withColumn("s_suppkey", F.lit(-1).cast(source.schema["s_suppkey"].dataType)))
    snapshots.write_snapshot(target, path)
    spec = d.DiffSpec(keys=["s_suppkey", "nation"])
    plan = versioned.sync_plan(d.row_diff(source, snapshots.read_snapshot(t.spark, path), spec), spec.keys)
    versioned.apply_sync(t.spark, path, plan, spec.keys)
    again = d.row_diff(source, snapshots.read_snapshot(t.spark, path), spec)
    return again.groupBy("status").agg(F.count(F.lit(1)).alias("row_count"))


@query("multi_table_compare", f"""
WITH {ORDERS_DIFF},
sup AS (SELECT s.s_suppkey AS a, c.s_suppkey AS b, s.s_acctbal AS x, c.s_acctbal AS y
  FROM {{supplier}} s FULL OUTER JOIN ({SUPPLIER_COPY}) c ON s.s_suppkey = c.s_suppkey),
sup_status AS (SELECT CASE WHEN abs(x - y) < 1e-9 THEN 'MATCH' ELSE 'DIFFERENT' END AS status FROM sup)
SELECT 'orders' AS table_name, (SELECT count(*) FROM {{orders}}) AS total_source,
  (SELECT count(*) FROM copy) AS total_target, {_SUMMARY}, false AS failed FROM pair
UNION ALL SELECT 'supplier', (SELECT count(*) FROM {{supplier}}), (SELECT count(*) FROM {{supplier}}), {_SUMMARY}, false FROM sup_status
UNION ALL SELECT 'absent', NULL, NULL, NULL, NULL, NULL, NULL, NULL, true""")
def multi_table_compare(t: Tables):
    def absent():
        raise FileNotFoundError("absent")

    pairs = {
        "orders": lambda: (t.orders, t.sql(ORDERS_COPY), ORDER_KEY),
        "supplier": lambda: (t.supplier, t.sql(SUPPLIER_COPY), d.DiffSpec(keys=["s_suppkey"])),
        "absent": absent,
    }
    out = d.compare_many(t.spark, pairs, history_path=t.scratch("history"), run_id="1")
    return out.withColumn("failed", F.col("error_message").isNotNull()).drop("error_message")


# Two catalogs: the given tables, and the same with a column renamed, a type changed and tables missing.
def _catalogs(t: Tables):
    left = {"customer": (t.customer, ["c_custkey"]), "supplier": (t.supplier, ["s_suppkey"]), "region": (t.region, ["r_regionkey"])}
    right = {"customer": (t.customer.withColumn("c_acctbal", F.col("c_acctbal").cast("decimal(12,2)"))
                          .withColumnRenamed("c_name", "C_NAME"), ["c_custkey"]),
             "supplier": (t.sql(SUPPLIER_COPY), ["s_suppkey"]), "nation": (t.nation, ["n_nationkey"])}
    return left, right


def _filled(tables: dict, side: str):
    """How many rows hold a value, per table and column: one pass per table."""
    out = None
    for name, (df, _) in tables.items():
        counts = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns])
        part = counts.select(F.explode(F.array(*[
            F.struct(F.lit(name).alias("table_name"), F.lit(c).alias("name"), F.col(c).alias(f"{side}_filled"))
            for c in df.columns])).alias("r")).select("r.*")
        out = part if out is None else out.unionByName(part)
    return out


_SCHEMA_ROWS = [
    ("customer", "c_custkey", "c_custkey", "IDENTICAL"), ("customer", "c_name", None, "SOURCE_ONLY"),
    ("customer", None, "C_NAME", "TARGET_ONLY"), ("customer", "c_nationkey", "c_nationkey", "IDENTICAL"),
    ("customer", "c_acctbal", "c_acctbal", "DIFFERENT"), ("customer", "c_mktsegment", "c_mktsegment", "IDENTICAL"),
    *[("supplier", c, c, "IDENTICAL") for c in ("s_suppkey", "s_name", "s_nationkey", "s_acctbal")],
    *[("region", c, None, "SOURCE_ONLY") for c in ("r_regionkey", "r_name")],
    *[("nation", None, c, "TARGET_ONLY") for c in ("n_nationkey", "n_name", "n_regionkey")],
]


@query("schema_compare_tables", " UNION ALL ".join(
    f"SELECT '{table}' AS table_name, '{a or b}' AS name, '{status}' AS status, "
    f"{f'(SELECT count({a}) FROM {{{table}}})' if a else 'NULL'} AS source_filled, "
    f"{f'(SELECT count({b}) FROM {{{table}}})' if b else 'NULL'} AS target_filled" for table, a, b, status in _SCHEMA_ROWS))
def schema_compare_tables(t: Tables):
    """Columns of two catalogs with their status, and how many rows fill them on each side."""
    left, right = _catalogs(t)
    status = schema.schema_compare(schema.catalog_frame(t.spark, left), schema.catalog_frame(t.spark, right))
    return status.select("table_name", "name", "status").join(_filled(left, "source"), ["table_name", "name"], "left") \
        .join(_filled(right, "target"), ["table_name", "name"], "left")


@query("auto_map_compare", f"""
WITH sup AS (SELECT CASE WHEN abs(s.s_acctbal - c.s_acctbal) < 1e-9 THEN 'MATCH' ELSE 'DIFFERENT' END AS status
  FROM {{supplier}} s JOIN ({SUPPLIER_COPY}) c ON s.s_suppkey = c.s_suppkey)
SELECT 'customer' AS table_name, 'DIFFERENT' AS schema_status, 'c_custkey' AS keys, count(*) AS total_source, 0 AS total_differences FROM {{customer}}
UNION ALL SELECT 'supplier', 'IDENTICAL', 's_suppkey', count(*), count(*) FILTER (WHERE status = 'DIFFERENT') FROM sup
UNION ALL SELECT 'region', 'SOURCE_ONLY', 'r_regionkey', NULL, NULL UNION ALL SELECT 'nation', 'TARGET_ONLY', 'n_nationkey', NULL, NULL""")
def auto_map_compare(t: Tables):
    """Pair the tables of two catalogs by name, then compare the pairs by the keys found."""
    left, right = _catalogs(t)
    a, b = schema.catalog_frame(t.spark, left), schema.catalog_frame(t.spark, right)
    mapped = schema.auto_map(a, b).collect()  # one row per table
    pairs = {m["table_name"]: (lambda m=m: (left[m["source_table"]][0], right[m["target_table"]][0], d.DiffSpec(keys=m["keys"])))
             for m in mapped if m["source_table"] and m["target_table"]}
    found = d.compare_many(t.spark, pairs).select("table_name", "total_source", "total_differences")
    named = t.spark.createDataFrame([(m["table_name"], ",".join(m["keys"])) for m in mapped], "table_name string, keys string")
    return schema.schema_compare_all(a, b).select("table_name", F.col("status").alias("schema_status")) \
        .join(named, "table_name").join(found, "table_name", "left")


@query("run_history_orders", """
SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS run_day, o_orderstatus AS state FROM {orders}
WHERE o_custkey % 10 = 3 ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50""")
def run_history_orders(t: Tables):
    runs = t.orders.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 10).alias("schedule_id"),
                           F.col("o_orderdate").alias("run_time"), F.col("o_orderstatus").alias("state"))
    return d.run_history(runs, 3, 50).select("id", F.date_format("run_time", "yyyy-MM-dd").alias("run_day"), "state")


@query("template_queries", """
SELECT c_custkey AS mapping_id, CASE WHEN n_nationkey % 3 = 0 OR n_name IS NULL THEN c_name ELSE n_name END AS query_text,
  CASE WHEN n_nationkey IS NULL THEN c_mktsegment ELSE CAST(n_regionkey AS VARCHAR) END AS key_columns
FROM {customer} LEFT JOIN {nation} ON c_nationkey = n_nationkey AND c_custkey % 2 = 0""")
def template_queries(t: Tables):
    mappings = t.sql("""SELECT c_custkey AS mapping_id, CASE WHEN c_custkey % 2 = 0 THEN c_nationkey END AS template_id,
      c_name AS query_text, c_mktsegment AS key_columns FROM {customer}""")
    templates = t.sql("""SELECT n_nationkey AS template_id, CASE WHEN n_nationkey % 3 = 0 THEN '  ' ELSE n_name END AS query_text,
      CAST(n_regionkey AS STRING) AS key_columns FROM {nation}""")
    return d.resolve_mappings(mappings, templates).drop("template_id")


@query("export_by_status_orders", f"""WITH {ORDERS_DIFF}
SELECT status, CAST(k AS VARCHAR) AS row_key, {_render('o_totalprice')} FROM pair WHERE status <> 'MATCH'""")
def export_by_status_orders(t: Tables):
    path = t.scratch("report")
    d.export_diff(orders_diff(t, return_matched=False), path)
    return t.spark.read.parquet(f"{path}/rows").select("status", "row_key", "o_totalprice")


@query("deterministic_sort_orders", """
SELECT o_orderkey, o_orderpriority, row_number() OVER (ORDER BY o_orderpriority, o_orderkey) AS position FROM {orders}""")
def deterministic_sort_orders(t: Tables):
    ordered = ranking.ordered(t.orders, d.DiffSpec(keys=["o_orderkey"], sort=["o_orderpriority"]))
    return ranking.with_row_number(ordered, ["o_orderpriority", "o_orderkey"], "position") \
        .select("o_orderkey", "o_orderpriority", "position")


@query("surrogate_row_number_lineitem", """
SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey,
  l_quantity, l_extendedprice, l_shipdate) AS __rn__ FROM {lineitem}""")
def surrogate_row_number_lineitem(t: Tables):
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]
    return ranking.with_row_number(t.lineitem, order).select("l_orderkey", "l_linenumber", "l_partkey", "__rn__")


@query("norm_eq_mixed_types", """
SELECT o_orderkey, true AS price_as_text, o_orderkey % 3 <> 0 AS key_as_text, o_orderkey % 2 = 1 AS flag_as_number,
  true AS padded_text, false AS null_is_not_blank, true AS stamp_text FROM {orders}""")
def norm_eq_mixed_types(t: Tables):
    changed = t.orders.select(
        "*", F.concat(F.col("o_totalprice").cast("string"), F.lit("00")).alias("price_text"),
        F.concat(F.lit(" "), (F.col("o_orderkey") + F.when(F.col("o_orderkey") % 3 == 0, 1).otherwise(0)).cast("string")).alias("key_text"),
        (F.col("o_orderkey") % 2 == 1).alias("flag"), F.concat(F.lit("\t"), F.lower("o_orderpriority")).alias("padded"),
        F.lit("").alias("blank"), F.lit(None).cast("string").alias("nothing"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("stamp"))
    types = {f.name: f.dataType for f in changed.schema.fields}

    def eq(a, b):
        return norm_eq(F.col(a), F.col(b), types[a], types[b])

    one = F.lit(1)
    return changed.select(
        "o_orderkey", eq("o_totalprice", "price_text").alias("price_as_text"), eq("o_orderkey", "key_text").alias("key_as_text"),
        norm_eq(F.col("flag"), one, types["flag"], types["o_custkey"]).alias("flag_as_number"),
        eq("o_orderpriority", "padded").alias("padded_text"), eq("blank", "nothing").alias("null_is_not_blank"),
        eq("o_orderdate", "stamp").alias("stamp_text"))
