"""Queries over rows: sources, filters, quality rules, numbering, monitoring, contacts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F, types as T

from evenkeel.functions import values
from evenkeel.operators import contacts, diff, filters, incremental, monitor, quality, ranking, schema
from evenkeel.plans.base import TABLES, Tables, query
from evenkeel.sources import csvfiles, tables

# ---------------------------------------------------------------- sources and sinks


@query("scan_table_supplier", "SELECT s_suppkey, s_name, s_acctbal FROM {supplier} WHERE s_nationkey < 10")
def scan_table_supplier(t: Tables):
    source = tables.Source(format="parquet", path=t.folder)
    return tables.scan(t.spark, source, table="supplier.parquet").filter("s_nationkey < 10") \
        .select("s_suppkey", "s_name", "s_acctbal")


@query("adhoc_query_orders", """
SELECT o_orderpriority, count(*) AS order_count, round(avg(o_totalprice), 4) AS mean_price FROM {orders}
WHERE o_orderstatus = 'F' AND o_totalprice >= 1000 GROUP BY o_orderpriority""")
def adhoc_query_orders(t: Tables):
    tables.register_tables(t.spark, t.folder, ["orders"])
    return tables.adhoc_query(t.spark, """
        SELECT o_orderpriority, count(*) AS order_count, round(avg(o_totalprice), 4) AS mean_price FROM orders
        WHERE o_orderstatus = :status AND o_totalprice >= :least GROUP BY o_orderpriority;""",
                              params={"status": "F"}, defaults={"least": 1000.0, "status": "O"})


@query("bind_params_events", """
SELECT event_type, count(*) AS event_count, 'ana' AS asked_by, true AS is_past FROM {events}
WHERE event_type <> ':none' AND value > 100 GROUP BY event_type""")
def bind_params_events(t: Tables):
    tables.register_tables(t.spark, t.folder, ["events"])
    return tables.adhoc_query(t.spark, """
        SELECT event_type, count(*) AS event_count, :sys_user AS asked_by, max(ts) < :sys_now AS is_past FROM events
        WHERE event_type <> ':none' AND value > :least GROUP BY event_type""",
                              params={"least": 100}, system=tables.system_values(sys_user="ana"))


@query("preview_orders", "SELECT CAST(least(200, count(*)) AS BIGINT) AS row_count, 6 AS column_count FROM {orders}")
def preview_orders(t: Tables):
    shown = tables.preview(t.orders)
    return shown.agg(F.count(F.lit(1)).alias("row_count")).withColumn("column_count", F.lit(len(shown.columns)))


@query("csv_round_trip_customer", """
SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name || ', "x"' AS c_name,
  CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS segment_1 FROM {customer}""")
def csv_round_trip_customer(t: Tables):
    path = t.scratch("csv")
    csvfiles.csv_export(t.customer.select(
        "c_custkey", F.concat("c_name", F.lit(', "x" ')).alias("c_name"), F.lit(" ").alias("Segment"),
        F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("segment ")), path)
    back = csvfiles.csv_ingest(t.spark, path)
    return back.select("c_custkey", "c_name", F.col(back.columns[-1]).alias("segment_1"))


@query("tail_log_events", """
SELECT user_id AS "partition", event_id AS "offset", event_type FROM
  (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM {events}) WHERE rn <= 10""")
def tail_log_events(t: Tables):
    log = t.events.select(F.col("user_id").alias("partition"), F.col("event_id").alias("offset"), "event_type")
    return ranking.tail_log(log, 10)


# ---------------------------------------------------------------- filters


@query("structured_filter_customer", """
SELECT c_custkey, c_name FROM {customer} WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal >= 1000
  AND c_name ILIKE 'customer#%7' AND c_nationkey IS NOT NULL AND c_nationkey NOT IN (3, 4)""")
def structured_filter_customer(t: Tables):
    return filters.structured_filter(t.customer, [
        {"field": "c_mktsegment", "op": "in", "value": "BUILDING, MACHINERY"},
        {"field": "c_acctbal", "op": ">=", "value": 1000},
        {"field": "c_name", "op": "ILIKE", "value": "customer#%7"},
        {"field": "c_nationkey", "op": "IS NOT NULL"},
        {"field": "c_nationkey", "op": "NOT IN", "value": [3, 4]},
        {"field": "c_nationkey", "op": "NOT IN", "value": []},
        {"op": "="}, {"field": "c_name"},
    ]).select("c_custkey", "c_name")


@query("range_query_orders", """
SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_orderdate >= '1997-01-01' AND o_orderdate <= '1997-12-31'
  AND o_orderstatus = 'O'""")
def range_query_orders(t: Tables):
    return filters.range_query(t.orders, "o_orderdate", "1997-01-01", "1997-12-31", "o_orderstatus = 'O'") \
        .select("o_orderkey", "o_totalprice")


@query("simple_select_customer", """
SELECT DISTINCT c_mktsegment, CAST(c_nationkey AS VARCHAR) AS c_nationkey FROM {customer} WHERE c_acctbal > 0
ORDER BY c_mktsegment DESC, CAST(c_nationkey AS INT) LIMIT 20 OFFSET 20""")
def simple_select_customer(t: Tables):
    return filters.simple_select(t.customer, ["c_mktsegment", "c_nationkey"], distinct=True, where="c_acctbal > 0",
                                 order=["c_mktsegment desc", "c_nationkey"], limit=20, page=2)


@query("search_any_part", """
SELECT p_partkey, p_name, p_brand FROM {part} WHERE lower(p_name) LIKE '%red%' OR lower(p_brand) LIKE '%red%'
  OR lower(p_type) LIKE '%red%'""")
def search_any_part(t: Tables):
    return filters.search_any(t.part, " RED ").select("p_partkey", "p_name", "p_brand")


EVENT_IP = "'10.0.' || CAST(user_id % 7 AS VARCHAR) || '.' || CAST(user_id % 200 AS VARCHAR)"


@query("ip_allowlist_events", f"""
SELECT event_id, {EVENT_IP} AS client_ip FROM {{events}}
WHERE user_id % 7 = 1 OR {EVENT_IP} = '10.0.2.9' OR (user_id % 7 = 3 AND user_id % 200 < 64) OR (user_id % 7 IN (4, 5))""")
def ip_allowlist_events(t: Tables):
    events = t.sql(f"SELECT event_id, {EVENT_IP.replace('VARCHAR', 'STRING')} AS client_ip FROM {{events}}")
    return filters.ip_allowlist(events, "10.0.1.*; 10.0.2.9\n10.0.3.0/26, 10.0.4.0/23, localhost")


@query("pk_not_null_orders", f"""
SELECT o.k, c_name FROM (SELECT CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey END AS k, o_custkey FROM {{orders}}) o
LEFT JOIN (SELECT * FROM {{customer}} WHERE c_custkey % 2 = 0) ON o_custkey = c_custkey WHERE o.k IS NOT NULL""")
def pk_not_null_orders(t: Tables):
    driving = t.sql("SELECT CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey END AS k, o_custkey FROM {orders}")
    other = t.customer.filter("c_custkey % 2 = 0")
    return filters.pk_not_null(driving, ["k"]).join(other, F.col("o_custkey") == F.col("c_custkey"), "left").select("k", "c_name")


@query("date_guard_keep_deletes", """
SELECT o_orderkey, o_orderkey % 11 = 0 AS is_deleted FROM {orders}
WHERE o_orderkey % 11 = 0 OR year(o_orderdate) = 1998""")
def date_guard_keep_deletes(t: Tables):
    changes = t.orders.withColumn("is_deleted", F.col("o_orderkey") % 11 == 0)
    return filters.filter_keep_deletes(changes, "year(o_orderdate) = 1998").select("o_orderkey", "is_deleted")


# ---------------------------------------------------------------- quality

CUSTOMER_RULES = [
    quality.RowRule("c_name", transform="trim,upper", min_length=5, max_length=18, pattern=r"CUSTOMER#\d+"),
    quality.RowRule("c_acctbal", type="number", min=0, max=9000),
    quality.RowRule("c_mktsegment", required=True, allowed=["building", "MACHINERY ", "FURNITURE"]),
    quality.RowRule("code", type="integer", required=False, default="7", message="bad code"),
    quality.RowRule("flag", type="boolean", required=True),
    quality.RowRule("day", type="date"),
]
CUSTOMER_INPUT = """
SELECT c_custkey, c_name, CAST(c_acctbal AS {text}) AS c_acctbal,
       CASE WHEN c_custkey % 9 = 0 THEN '  ' ELSE c_mktsegment END AS c_mktsegment,
       CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 4 = 1 THEN 'x1' ELSE CAST(c_custkey AS {text}) END AS code,
       CASE WHEN c_custkey % 5 = 0 THEN 'TRUE' WHEN c_custkey % 5 = 1 THEN '0' WHEN c_custkey % 5 = 2 THEN 'maybe' ELSE ' 1 ' END AS flag,
       CASE WHEN c_custkey % 6 = 0 THEN '2024-02-30' WHEN c_custkey % 6 = 1 THEN '2024-02-29' ELSE NULL END AS day
FROM {customer}
"""


def _customer_input(t: Tables):
    return t.sql(CUSTOMER_INPUT.replace("{text}", "STRING"))


_RULE_ERRORS = """concat_ws('; ',
  CASE WHEN length(c_name) > 18 THEN 'c_name is longer than 18' END,
  CASE WHEN NOT regexp_full_match(upper(trim(c_name)), 'CUSTOMER#[0-9]+') THEN 'c_name has the wrong format' END,
  CASE WHEN CAST(c_acctbal AS DOUBLE) < 0 THEN 'c_acctbal is below 0' END,
  CASE WHEN CAST(c_acctbal AS DOUBLE) > 9000 THEN 'c_acctbal is above 9000' END,
  CASE WHEN trim(c_mktsegment) = '' THEN 'c_mktsegment is required' END,
  CASE WHEN trim(c_mktsegment) <> '' AND lower(c_mktsegment) NOT IN ('building', 'machinery', 'furniture')
       THEN 'c_mktsegment must be one of [building, MACHINERY , FURNITURE]' END,
  CASE WHEN code = 'x1' THEN 'bad code' END,
  CASE WHEN flag = 'maybe' THEN 'flag is not a valid boolean' END,
  CASE WHEN day = '2024-02-30' THEN 'day is not a valid date' END)"""


@query("validate_rows_customer", f"""
WITH input AS ({CUSTOMER_INPUT.replace('{text}', 'VARCHAR')})
SELECT c_custkey, upper(c_name) AS c_name, CAST(c_acctbal AS DOUBLE) AS c_acctbal, nullif(trim(c_mktsegment), '') AS c_mktsegment,
  CASE WHEN code IS NULL THEN 7 ELSE TRY_CAST(code AS INTEGER) END AS code,
  CASE WHEN flag IN ('TRUE', ' 1 ') THEN true WHEN flag = '0' THEN false END AS flag,
  CASE WHEN day = '2024-02-29' THEN day END AS day, {_RULE_ERRORS} AS errors FROM input""")
def validate_rows_customer(t: Tables):
    checked = quality.validate_rows(_customer_input(t), CUSTOMER_RULES)
    return checked.withColumns({"errors": F.array_join("errors", "; "), "day": F.col("day").cast("string")})


@query("split_valid_customer", f"""
WITH input AS ({CUSTOMER_INPUT.replace('{text}', 'VARCHAR')})
SELECT {_RULE_ERRORS} = '' AS valid, count(*) AS row_count FROM input GROUP BY 1""")
def split_valid_customer(t: Tables):
    good, bad = quality.split_valid(quality.validate_rows(_customer_input(t), CUSTOMER_RULES))
    return good.agg(F.lit(True).alias("valid"), F.count(F.lit(1)).alias("row_count")).unionByName(
        bad.agg(F.lit(False).alias("valid"), F.count(F.lit(1)).alias("row_count")))


@query("assert_counts_orders", """
SELECT 'no orphan' AS name, (SELECT count(*) FROM {orders} WHERE o_custkey NOT IN (SELECT c_custkey FROM {customer})) AS row_count,
  (SELECT count(*) FROM {orders} WHERE o_custkey NOT IN (SELECT c_custkey FROM {customer})) = 0 AS passed
UNION ALL SELECT 'some open', (SELECT count(*) FROM {orders} WHERE o_orderstatus = 'O'), (SELECT count(*) FROM {orders} WHERE o_orderstatus = 'O') > 0
UNION ALL SELECT 'one top', (SELECT count(*) FROM {orders} WHERE o_totalprice > 1000), (SELECT count(*) FROM {orders} WHERE o_totalprice > 1000) = 1""")
def assert_counts_orders(t: Tables):
    tables.register_tables(t.spark, t.folder, ["orders", "customer"])
    return quality.assert_counts(t.spark, [
        {"name": "no orphan", "expect": "EQ_0",
         "sql": "SELECT count(*) FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey)"},
        {"name": "some open", "expect": "GT_0", "sql": "SELECT count(*) FROM orders WHERE o_orderstatus = 'O'"},
        {"name": "one top", "expect": "EQ_1", "sql": "SELECT count(*) FROM orders WHERE o_totalprice > 1000"},
    ]).select("name", "row_count", "passed")


SLOTS = """SELECT user_id AS slot_name, max(event_id) % 3 <> 0 AS active,
  CAST(sum(CAST(round(value * 100) AS BIGINT)) * 10 AS BIGINT) AS wal_bytes FROM {events} GROUP BY user_id"""


@query("slot_alerts_events", f"""
SELECT * FROM (SELECT slot_name, active, wal_bytes * 20 AS wal_bytes FROM ({SLOTS}))
WHERE wal_bytes >= 15 * 1048576 OR (NOT active AND wal_bytes > 10 * 1048576)""")
def slot_alerts_events(t: Tables):
    slots = t.sql(SLOTS).withColumn("wal_bytes", F.col("wal_bytes") * 20)
    return quality.slot_alerts(slots, 15)


DISKS = """SELECT user_id % 20 AS host, 'dev' || CAST(event_id % 6 AS {text}) AS filesystem,
  '/mnt/' || event_type AS mount, (event_id * 37) % 101 AS usage_percent, event_id FROM {events}"""


@query("threshold_alerts_events", f"""
WITH m AS ({DISKS.replace('{text}', 'VARCHAR')}),
r AS (SELECT 'any' AS rule, '' AS target, 90 AS lim UNION ALL SELECT 'clicks', 'click', 80 UNION ALL SELECT 'absent', 'nvme', 95),
f AS (SELECT m.*, rule, lim, target = '' OR contains(mount, target) OR contains(filesystem, target) AS hit FROM m, r),
g AS (SELECT *, max(hit) OVER (PARTITION BY host, rule) AS any_hit FROM f)
SELECT event_id, host, rule FROM g WHERE usage_percent >= lim AND (hit OR NOT any_hit)""")
def threshold_alerts_events(t: Tables):
    return quality.threshold_alerts(t.sql(DISKS.replace("{text}", "STRING")), [
        {"rule": "any", "target": "all", "limit": 90}, {"rule": "clicks", "target": " Click", "limit": 80},
        {"rule": "absent", "target": "nvme", "limit": 95}]).select("event_id", "host", "rule")


@query("format_bytes_documents", """
SELECT doc_id, CASE WHEN b < 1024 THEN CAST(b AS VARCHAR) || ' B' WHEN b < 1048576 THEN printf('%.1f KiB', floor(b / 1024.0 * 10 + 0.5) / 10)
  WHEN b < 1073741824 THEN printf('%.2f MiB', floor(b / 1048576.0 * 100 + 0.5) / 100) ELSE printf('%.2f GiB', floor(b / 1073741824.0 * 100 + 0.5) / 100) END AS size
FROM (SELECT doc_id, n_chars * CASE doc_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 97 WHEN 2 THEN 9973 ELSE 999983 END AS b FROM {documents})""")
def format_bytes_documents(t: Tables):
    size = t.sql("SELECT doc_id, n_chars * CASE doc_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 97 WHEN 2 THEN 9973 ELSE 999983 END AS b FROM {documents}")
    return size.select("doc_id", values.format_bytes(F.col("b")).alias("size"))


# ---------------------------------------------------------------- numbering and pages

SEQUENCES = [
    {"seq_key": "1-URGENT", "prefix": "INV", "suffix": "", "date_format": "yyyyMM", "date_separator": "-",
     "pad_length": 5, "reset_type": "MONTHLY", "current_value": 0, "last_reset_date": None},
    {"seq_key": "2-HIGH", "prefix": "", "suffix": "X", "date_format": "yyyy", "date_separator": "/",
     "pad_length": 3, "reset_type": "YEARLY", "current_value": 40, "last_reset_date": "1995-06-01"},
    {"seq_key": "3-MEDIUM", "prefix": "M", "suffix": "Z", "date_format": "", "date_separator": ".",
     "pad_length": 2, "reset_type": "NEVER", "current_value": 1000, "last_reset_date": None},
]
_NUMBERED = """
SELECT o_orderkey, o_orderpriority, o_orderdate,
  row_number() OVER (PARTITION BY o_orderpriority, CASE o_orderpriority WHEN '1-URGENT' THEN date_trunc('month', o_orderdate)
    WHEN '2-HIGH' THEN date_trunc('year', o_orderdate) ELSE TIMESTAMP '1970-01-01' END ORDER BY o_orderdate, o_orderkey)
  + CASE WHEN o_orderpriority = '2-HIGH' AND year(o_orderdate) = 1995 THEN 40 WHEN o_orderpriority = '3-MEDIUM' THEN 1000 ELSE 0 END AS n
FROM {orders}"""


@query("document_numbers_orders", f"""
SELECT o_orderkey, CASE WHEN o_orderpriority[1] IN ('1', '2', '3') THEN n END AS number,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'INV-' || strftime(o_orderdate, '%Y%m') || '-' || lpad(CAST(n AS VARCHAR), 5, '0')
    WHEN '2-HIGH' THEN CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END || '/X'
    WHEN '3-MEDIUM' THEN 'M.' || CAST(n AS VARCHAR) || '.Z' END AS formatted
FROM ({_NUMBERED})""")
def document_numbers_orders(t: Tables):
    return ranking.document_numbers(t.orders, SEQUENCES, "o_orderpriority", "o_orderdate", ["o_orderkey"]) \
        .select("o_orderkey", "number", "formatted")


@query("document_numbers_hot_sequence", f"""
SELECT o_orderkey, CASE WHEN o_orderpriority[1] IN ('1', '2', '3') THEN n END AS number FROM ({_NUMBERED})""")
def document_numbers_hot_sequence(t: Tables):
    """The same numbers with the large sequences counted over ranges."""
    return ranking.document_numbers(t.orders, SEQUENCES, "o_orderpriority", "o_orderdate", ["o_orderkey"],
                                    share=0.05, min_rows=100).select("o_orderkey", "number")


@query("document_numbers_batches", f"""
WITH numbered AS (SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderpriority[1] IN ('1', '2', '3') THEN row_number() OVER (
    PARTITION BY o_orderpriority, CASE o_orderpriority WHEN '1-URGENT' THEN date_trunc('month', o_orderdate)
      WHEN '2-HIGH' THEN date_trunc('year', o_orderdate) ELSE TIMESTAMP '1970-01-01' END ORDER BY o_orderstatus = 'F', o_orderdate, o_orderkey)
    + CASE WHEN o_orderpriority = '2-HIGH' AND year(o_orderdate) = 1995 THEN 40 WHEN o_orderpriority = '3-MEDIUM' THEN 1000 ELSE 0 END END AS number
  FROM {{orders}})
SELECT o_orderkey, number FROM numbered""")
def document_numbers_batches(t: Tables):
    """Orders in two batches, finished ones in the second, and the first batch repeated after it."""
    counters = ranking.DocumentCounters(t.spark, t.scratch("counters"), SEQUENCES)
    rows = t.orders.select("o_orderkey", "o_orderpriority", "o_orderdate", "o_orderstatus")
    open_, done = rows.filter("o_orderstatus <> 'F'"), rows.filter("o_orderstatus = 'F'")
    give = lambda part, batch: counters.number(part, batch, "o_orderpriority", "o_orderdate", ["o_orderkey"])
    give(open_, 0)
    later = give(done, 1)
    return give(open_, 0).unionByName(later).select("o_orderkey", "number")


@query("paged_read_orders", "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice, o_orderkey LIMIT 500 OFFSET 1000")
def paged_read_orders(t: Tables):
    return ranking.paged(t.orders, ["o_totalprice", "o_orderkey"], 3, 500).select("o_orderkey", "o_totalprice")


@query("paged_ties_lineitem", """
SELECT CAST(ceil(rn / 5000) AS BIGINT) AS page, l_orderkey, l_linenumber, l_quantity FROM (
  SELECT l_orderkey, l_linenumber, l_quantity, row_number() OVER (ORDER BY l_quantity, l_orderkey, l_linenumber) AS rn
  FROM (SELECT DISTINCT l_quantity, l_orderkey, l_linenumber FROM {lineitem}))""")
def paged_ties_lineitem(t: Tables):
    """All pages over a column of fifty values: every row is on one page, in one order."""
    rows = t.lineitem.select("l_quantity", "l_orderkey", "l_linenumber").distinct()
    return ranking.PageIndex(rows, ["l_quantity"], 5000).numbered()


@query("page_info_orders", "SELECT count(*) AS total, CAST(ceil(count(*) / 700.0) AS BIGINT) AS pages FROM {orders}")
def page_info_orders(t: Tables):
    return ranking.page_info(t.orders, 700)


# ---------------------------------------------------------------- new rows, texts, retries


@query("high_water_read_events", """
SELECT event_id, value FROM {events} WHERE value > 20 OR (value = 20 AND event_id > 0)""")
def high_water_read_events(t: Tables):
    rows, _ = incremental.high_water_read(t.events, "value", (20.0, 0), ["event_id"])
    return rows.select("event_id", "value")


@query("high_water_mark_events", """
SELECT 'first' AS read, (SELECT max(value) FROM {events}) AS mark,
  (SELECT max(event_id) FROM {events} WHERE value = (SELECT max(value) FROM {events})) AS event_id, CAST(0 AS BIGINT) AS row_count
UNION ALL (SELECT 'next', value, event_id, count(*) OVER () FROM (SELECT value, event_id FROM {events} WHERE value > 20 ORDER BY value, event_id LIMIT 100)
  ORDER BY value DESC, event_id DESC LIMIT 1)""")
def high_water_mark_events(t: Tables):
    parts = []
    for name, mark in (("first", None), ("next", (20.0, (1 << 63) - 1))):  # above every row of that value
        rows, last = incremental.high_water_read(t.events, "value", mark, ["event_id"], cap=100)
        count = rows.agg(F.count(F.lit(1)).alias("row_count"))
        parts.append(last.select(F.lit(name).alias("read"), "mark", "event_id").join(F.broadcast(count)))
    return parts[0].unionByName(parts[1])


@query("high_water_cycles_events", """
SELECT user_id, count(*) AS row_count FROM {events} WHERE user_id IS NOT NULL GROUP BY 1""")
def high_water_cycles_events(t: Tables):
    """Reads of an eighth of the table each, over a column full of ties, together give every row once."""
    cap, mark, parts = max(1, t.events.count() // 8), None, []
    while True:
        rows, last = incremental.high_water_read(t.events, "user_id", mark, cap=cap, manual=True)
        found = last.first()
        if found is None:
            break
        parts.append(rows.select("user_id"))
        mark = found["mark"]
    return reduce(lambda a, b: a.union(b), parts).groupBy("user_id").agg(F.count(F.lit(1)).alias("row_count"))


@query("render_template_customer", """
SELECT c_custkey, 'Dear ' || c_name || ' (' || CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_mktsegment END || '), no. ' ||
  CAST(c_custkey AS VARCHAR) || ' { {' AS message FROM {customer}""")
def render_template_customer(t: Tables):
    rows = t.customer.withColumn("c_mktsegment", F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment")))
    return values.render_template(rows, "Dear {{ C_NAME }} ({{c_mktsegment}}), no. {{c_custkey}}{{unknown}} { {") \
        .select("c_custkey", "message")


_REACH = "substr(rest, 1, 4001)"
_CUT = f"""CASE WHEN length(rest) <= 4000 THEN 4000
  WHEN length(regexp_extract({_REACH}, '(?s)^(.*)\\n', 1)) > 500 THEN length(regexp_extract({_REACH}, '(?s)^(.*)\\n', 1))
  WHEN length(regexp_extract({_REACH}, '(?s)^(.*) ', 1)) > 500 THEN length(regexp_extract({_REACH}, '(?s)^(.*) ', 1))
  ELSE 4000 END"""


@query("split_long_text_documents", f"""
WITH RECURSIVE cutting AS (
  SELECT doc_id, 0 AS part, '' AS piece, text AS rest FROM {{documents}} WHERE length(text) > 4000
  UNION ALL
  SELECT doc_id, part + 1, trim(substr(rest, 1, cut), ' ' || chr(10) || chr(9) || chr(13)),
    ltrim(substr(rest, cut + 1), ' ' || chr(10)) FROM (SELECT *, {_CUT} AS cut FROM cutting WHERE rest <> '')),
pieces AS (SELECT doc_id, part, piece, max(part) OVER (PARTITION BY doc_id) AS parts FROM cutting WHERE part > 0)
SELECT doc_id, parts, part, CASE WHEN parts > 1 THEN piece || chr(10) || chr(10) || '<i>[Bagian ' || CAST(part AS VARCHAR) || '/'
  || CAST(parts AS VARCHAR) || ']</i>' ELSE piece END AS part_text FROM pieces
UNION ALL SELECT doc_id, 1, 1, text FROM {{documents}} WHERE length(text) <= 4000""")
def split_long_text_documents(t: Tables):
    return incremental.split_long_text(t.documents.select("doc_id", "text"), "text").drop("text")


@query("split_long_text_totals", """
SELECT count(*) AS doc_count, count(*) FILTER (WHERE n <= 4000) AS whole_count,
  CAST(sum(words) AS BIGINT) AS word_count FROM (SELECT length(text) AS n,
  len(regexp_extract_all(text, '[^ \\n]+')) AS words FROM {documents})""")
def split_long_text_totals(t: Tables):
    """Cutting keeps every document, leaves the short ones whole, and loses no word at soft cuts."""
    parts = incremental.split_long_text(t.documents.select("doc_id", "text"), "text", numbering="")
    words = F.size(F.filter(F.split("part_text", "[ \\n]+"), lambda w: w != ""))
    return parts.select("part", "parts", words.alias("w")).agg(
        F.count_if(F.col("part") == 1).alias("doc_count"), F.count_if(F.col("parts") == 1).alias("whole_count"),
        F.sum("w").alias("word_count"))


@query("retry_due_events", """
SELECT event_id, event_id % 5 AS round FROM {events}
WHERE ts + INTERVAL 60 SECOND <= TIMESTAMP '2024-01-15 00:00:00' AND event_id % 5 < 3""")
def retry_due_events(t: Tables):
    failed = t.events.select("event_id", (F.col("event_id") % 5 - 1).alias("round"), "ts")
    tasks = incremental.schedule_retry(failed, F.col("ts"))
    return incremental.retry_due(tasks, F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")).select("event_id", "round")


# ---------------------------------------------------------------- contacts

CONTACTS = """
SELECT c_custkey AS contact_id, CASE WHEN c_nationkey < 20 THEN 'bot1' ELSE 'bot2' END AS bot_id,
  CAST(700000 + c_custkey % 400 AS {text}) AS chat_id,
  CASE WHEN c_custkey % 3 = 0 THEN '+62 811-' ELSE '0811' END || CAST(1000 + c_custkey % 300 AS {text}) AS phone_number,
  CASE WHEN c_custkey % 2 = 0 THEN c_name END AS first_name, CASE WHEN c_custkey % 5 = 0 THEN c_mktsegment END AS last_name,
  CASE WHEN c_custkey % 7 = 0 THEN '' ELSE 'u' || CAST(c_custkey AS {text}) END AS username FROM {customer}
"""
RECIPIENTS = """
SELECT o_orderkey, CAST(700000 + o_custkey % 600 AS {text}) || '; 0811' || CAST(1000 + o_custkey % 350 AS {text}) || ',  '
  || 'x' || CAST(o_orderkey % 9 AS {text}) AS recipients FROM {orders}
"""
_PHONE = "CASE WHEN regexp_replace({c}, '[^0-9]', '', 'g') LIKE '0%' THEN '62' || substr(regexp_replace({c}, '[^0-9]', '', 'g'), 2) ELSE regexp_replace({c}, '[^0-9]', '', 'g') END"


@query("resolve_recipients_orders", f"""
WITH c AS (SELECT *, {_PHONE.format(c='phone_number')} AS norm,
    CASE WHEN trim(coalesce(first_name, '') || ' ' || coalesce(last_name, '')) <> '' THEN trim(coalesce(first_name, '') || ' ' || coalesce(last_name, ''))
      WHEN username <> '' THEN '@' || username ELSE chat_id END AS name
  FROM ({CONTACTS.replace('{text}', 'VARCHAR')}) WHERE bot_id = 'bot1'),
r AS (SELECT o_orderkey, unnest(regexp_split_to_array(recipients, '[,;\\s]+')) AS token FROM ({RECIPIENTS.replace('{text}', 'VARCHAR')})),
tok AS (SELECT DISTINCT token, {_PHONE.format(c='token')} AS norm FROM r),
hit AS (SELECT token, min(contact_id) AS contact_id FROM (
  SELECT token, contact_id FROM tok JOIN c ON token = chat_id UNION ALL SELECT token, contact_id FROM tok JOIN c ON token = phone_number
  UNION ALL SELECT token, contact_id FROM tok JOIN c ON tok.norm = c.norm AND tok.norm <> '') GROUP BY token)
SELECT o_orderkey, r.token, coalesce(c.chat_id, r.token) AS chat_id, coalesce(c.name, r.token) AS recipient_name,
  coalesce(c.phone_number, r.token) AS recipient_phone
FROM r LEFT JOIN hit ON r.token = hit.token LEFT JOIN c ON hit.contact_id = c.contact_id""")
def resolve_recipients_orders(t: Tables):
    return contacts.resolve_recipients(
        t.sql(RECIPIENTS.replace("{text}", "STRING")), t.sql(CONTACTS.replace("{text}", "STRING")), "recipients", "bot1") \
        .drop("recipients")


@query("fixed_recipients_orders", f"""
SELECT o_orderkey, chat_id, recipient_phone FROM {{orders}}, (
  SELECT chat_id, phone_number AS recipient_phone FROM ({CONTACTS.replace('{text}', 'VARCHAR')}) WHERE contact_id IN (3, 14)
  UNION ALL SELECT 'none', '-')""")
def fixed_recipients_orders(t: Tables):
    return contacts.fixed_recipients(t.orders, t.sql(CONTACTS.replace("{text}", "STRING")),
                                     "3, 14;none").select("o_orderkey", "chat_id", "recipient_phone")


@query("enrich_by_lookup_orders", """
SELECT o_custkey, c_name, c_acctbal, n_name FROM {orders} JOIN {customer} ON o_custkey = c_custkey
  JOIN {nation} ON n_nationkey = c_nationkey""")
def enrich_by_lookup_orders(t: Tables):
    view = t.sql("""SELECT c_custkey AS o_custkey, c_name, c_acctbal, n_name FROM {customer}
      JOIN {nation} ON n_nationkey = c_nationkey""")
    return contacts.enrich(t.orders, view, ["o_custkey"])


@query("detect_query_keys_lines", """
SELECT l_orderkey AS my_o_orderkey, count(*) AS row_count FROM {lineitem} GROUP BY 1""")
def detect_query_keys_lines(t: Tables):
    """The key of a query's output, found by the name of its table's key."""
    rows = t.sql("SELECT l_linenumber, l_orderkey AS my_o_orderkey, l_quantity FROM {lineitem}")
    keys = schema.detect_keys(rows.columns, ["o_orderkey"])
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count"))


@query("sanitize_columns_customer", """
SELECT c_custkey AS c_custkey, c_name AS the_name, c_acctbal AS balance FROM {customer}""")
def sanitize_columns_customer(t: Tables):
    rows = t.customer.select("c_custkey", F.col("c_name").alias("The Name"), F.col("c_acctbal").alias("Balance"))
    return csvfiles.sanitize_columns(rows)


# ---------------------------------------------------------------- monitoring


@query("consumer_lag_events", """
WITH e AS (SELECT event_type AS topic, user_id AS part, max(event_id) AS done FROM {events} GROUP BY 1, 2),
c AS (SELECT event_type AS topic, user_id AS part, max(event_id) AS done FROM {events} WHERE event_id % 7 <> 0 GROUP BY 1, 2)
SELECT CAST(coalesce(sum(greatest(e.done - c.done, 0)), 0) AS BIGINT) AS lag FROM e JOIN c USING (topic, part)""")
def consumer_lag_events(t: Tables):
    def offsets(where):
        return t.sql(f"""SELECT event_type AS topic, user_id AS `partition`, max(event_id) AS `offset` FROM {{events}}
          WHERE {where} GROUP BY 1, 2""")
    return monitor.consumer_lag(offsets("event_id % 7 <> 0"), offsets("true"))


@query("snapshot_progress_orders", """
SELECT count(*) AS source_count, count(*) FILTER (WHERE o_orderkey % 3 = 0) AS target_count,
  round(count(*) FILTER (WHERE o_orderkey % 3 = 0) * 100.0 / count(*), 2) AS percent, false AS complete FROM {orders}""")
def snapshot_progress_orders(t: Tables):
    return monitor.snapshot_progress(t.orders, t.orders.filter("o_orderkey % 3 = 0"))


@query("delivery_log_events", """
SELECT user_id AS run_id, count(*) AS row_count, count(*) FILTER (WHERE value > 5) AS sent_count,
  count(*) FILTER (WHERE NOT value > 5) AS failed_count,
  CASE WHEN count(*) FILTER (WHERE NOT value > 5) = 0 THEN 'SUCCESS' WHEN count(*) FILTER (WHERE value > 5) > 0 THEN 'PARTIAL'
    ELSE 'FAILED' END AS state FROM {events} GROUP BY user_id""")
def delivery_log_events(t: Tables):
    return monitor.delivery_summary(t.events.select(F.col("user_id").alias("run_id"), (F.col("value") > 5).alias("sent")))


@query("table_stats", " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS row_count FROM {{{n}}}" for n in TABLES))
def table_stats(t: Tables):
    parts = [schema.table_stats(getattr(t, n)).select(F.lit(n).alias("table_name"), "row_count") for n in TABLES]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("evolve_schema_customer", """
SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal AS balance FROM {customer}""")
def evolve_schema_customer(t: Tables):
    new = T.StructType.fromDDL("c_custkey long, c_name string, c_nationkey long, balance double")
    source = t.customer.select("c_custkey", F.col("c_acctbal").alias("balance"))
    return schema.evolve(t.customer, new, source, ["c_custkey"])


@query("resolve_keys_lineitem", """
SELECT l_orderkey, l_linenumber, count(*) AS row_count FROM {lineitem} GROUP BY l_orderkey, l_linenumber""")
def resolve_keys_lineitem(t: Tables):
    keys = diff.resolve_keys(diff.DiffSpec(sort=[], declared_keys=["L_ORDERKEY", "l_LineNumber"]), t.lineitem)
    return diff.status_counts(t.lineitem, keys)
