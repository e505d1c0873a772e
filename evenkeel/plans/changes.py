"""Change-data queries: versioned tables, change events, warehouse refresh."""

from __future__ import annotations

from pyspark.sql import functions as F

from evenkeel.functions import json as js
from evenkeel.functions import values
from evenkeel.operators import ranking, versioned
from evenkeel.plans.base import Tables, query
from evenkeel.sources import snapshots
from evenkeel.sources.manifests import BucketTable
from evenkeel.streaming import buckets, changes, retries, warehouse

LANDING = """
SELECT user_id, event_type, value, props, event_id // 3 AS version, event_type = 'error' AS is_deleted,
       event_id AS ingest_seq FROM {events}
"""
_LANDING_SPARK = LANDING.replace("event_id // 3", "event_id DIV 3")
_LATEST = f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY version DESC, ingest_seq DESC) AS rn
  FROM ({LANDING})) WHERE rn = 1"""


@query("latest_version_events", f"SELECT user_id, event_type, value, props, version, is_deleted, ingest_seq FROM ({_LATEST})")
def latest_version_events(t: Tables):
    return versioned.latest_version(t.sql(_LANDING_SPARK), ["user_id"])


@query("upsert_late_rows", """
SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_orderkey % 5 <> 0""")
def upsert_late_rows(t: Tables):
    """Insert, delete and a late update of a deleted key, each in a batch, in two orders."""
    base = t.orders.select("o_orderkey", "o_totalprice")
    rows = lambda df, version, gone: df.withColumns({"version": F.lit(version).cast("long"), "is_deleted": F.lit(gone)})
    fifth = base.filter("o_orderkey % 5 = 0")
    batches = [rows(base, 10, False), rows(fifth, 20, True), rows(fifth.withColumn("o_totalprice", F.lit(0.0).cast(
        base.schema["o_totalprice"].dataType)), 15, False)]
    found = []
    for turn in ((0, 1, 2), (1, 2, 0)):
        path = t.scratch("late")
        for i in turn:
            versioned.upsert(t.spark, path, batches[i], ["o_orderkey"], sequence=None)
        found.append(versioned.read_upserted(t.spark, path).select("o_orderkey", "o_totalprice"))
    # Both orders give the same table, so what differs would show as further rows.
    return found[0].union(found[1].exceptAll(found[0])).union(found[0].exceptAll(found[1]))


@query("current_view_events", f"SELECT user_id, event_type, value FROM ({_LATEST}) WHERE NOT is_deleted")
def current_view_events(t: Tables):
    return versioned.current_view(t.sql(_LANDING_SPARK), ["user_id"]).select("user_id", "event_type", "value")


@query("compact_events", f"SELECT user_id, event_type, value, is_deleted FROM ({_LATEST})")
def compact_events(t: Tables):
    path = t.scratch("landing")
    snapshots.write_snapshot(t.sql(_LANDING_SPARK), path)
    done = versioned.compact_many(t.spark, {"dwh_events": (path, ["user_id"]), "cdc_other": (path, ["user_id"])},
                                  pattern="DWH%", skip_landing=True)
    assert [r["state"] for r in done.collect()] == ["DONE"]
    return snapshots.read_snapshot(t.spark, path).select("user_id", "event_type", "value", "is_deleted")


@query("upsert_sink_events", f"SELECT user_id, event_type, value FROM ({_LATEST}) WHERE NOT is_deleted")
def upsert_sink_events(t: Tables):
    """Two batches, the second replayed, land as the current view of both."""
    path = t.scratch("upsert")
    rows = t.sql(_LANDING_SPARK).withColumn("is_deleted", F.lit(False))
    versioned.upsert(t.spark, path, rows.filter("ingest_seq % 2 = 0"), ["user_id"])
    late = t.sql(_LANDING_SPARK)
    for _ in range(2):
        versioned.upsert(t.spark, path, late, ["user_id"])
    return versioned.read_upserted(t.spark, path).select("user_id", "event_type", "value")


@query("upsert_buckets_events", f"SELECT user_id, event_type, value FROM ({_LATEST}) WHERE NOT is_deleted")
def upsert_buckets_events(t: Tables):
    """Batches out of order, one replayed, one appended and compacted, in a table of buckets."""
    table = BucketTable(t.spark, t.scratch("buckets"), ["user_id"], buckets=16)
    rows = t.sql(_LANDING_SPARK)
    for number, part in enumerate((2, 0, 1)):
        table.upsert(rows.filter(F.col("ingest_seq") % 4 == part), number)
    table.upsert(rows.filter("ingest_seq % 4 = 0"), 1)
    table.append(rows.filter("ingest_seq % 4 = 3"), 3)
    table.compact()
    table.expire()
    return table.read().filter("not is_deleted").select("user_id", "event_type", "value")


@query("consolidate_customer", """
SELECT CASE c_nationkey % 3 WHEN 0 THEN 'north' WHEN 1 THEN 'south' ELSE 'west' END AS source_db, c_custkey % 500 AS k,
  c_name, CASE WHEN c_nationkey % 3 = 2 THEN c_acctbal END AS c_acctbal FROM {customer}
WHERE c_nationkey % 3 <> 1 OR c_custkey % 10 <> 0""")
def consolidate_customer(t: Tables):
    base = t.customer.withColumn("k", F.col("c_custkey") % 500)
    part = [base.filter(F.col("c_nationkey") % 3 == i) for i in range(3)]
    return versioned.consolidate({
        "north": part[0].select("k", "c_name"),
        "south": part[1].select("k", "c_name", F.when(F.col("c_custkey") % 10 == 0, True).otherwise(
            F.when(F.col("c_custkey") % 2 == 0, False)).alias("is_deleted")),
        "west": part[2].select("k", "c_name", "c_acctbal"),
    }).select("source_db", "k", "c_name", "c_acctbal")


@query("consolidate_query_orders", """
SELECT CASE n_regionkey % 2 WHEN 0 THEN 'even' ELSE 'odd' END AS source_db, n_name, count(*) AS customers
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey GROUP BY 1, 2""")
def consolidate_query_orders(t: Tables):
    def by_nation(tables):
        joined = tables["customer"].join(tables["nation"], F.col("c_nationkey") == F.col("n_nationkey"))
        return joined.groupBy("n_name").agg(F.count(F.lit(1)).alias("customers"))

    sources = {name: {"customer": t.customer, "nation": t.nation.filter(F.col("n_regionkey") % 2 == rest)}
               for name, rest in (("even", 0), ("odd", 1))}
    return versioned.consolidate_query(by_nation, sources).drop("sync_dt")


@query("copy_if_empty_customer", """
SELECT c_nationkey, c_mktsegment, max(c_custkey) AS c_custkey FROM {customer}
WHERE c_nationkey >= 5 OR c_mktsegment <> 'BUILDING' GROUP BY 1, 2""")
def copy_if_empty_customer(t: Tables):
    rows = t.customer.select("c_custkey", "c_nationkey", "c_mktsegment")
    have = rows.filter("c_nationkey < 5 AND c_mktsegment = 'BUILDING'")
    assert versioned.copy_if_empty(rows, have, ["c_nationkey"]).isEmpty()
    return versioned.copy_missing(rows, have, ["c_nationkey", "c_mktsegment"])


# ---------------------------------------------------------------- change events

ORDER_ROW = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double"

# Messages made from orders: every order created, some updated, some deleted, tombstones, heartbeats.
CHANGE_STATES = [
    ("true", "c", 0, "O", 0), ("o_orderkey % 7 = 0", "u", 10_000_000, "F", 1),
    ("o_orderkey % 11 = 0", "d", 20_000_000, "F", 2),
]


def _message(op: str, lsn: int, status: str):
    row = F.struct("o_orderkey", "o_custkey", F.lit(status).alias("o_orderstatus"), "o_totalprice")
    envelope = F.struct(
        F.lit(op).alias("op"), (F.lit(None).cast("string") if op == "d" else row).alias("after"),
        (row if op == "d" else F.lit(None).cast("string")).alias("before"),
        F.struct((F.col("o_orderkey") + lsn).alias("lsn")).alias("source"), F.lit(1700000000000).alias("ts_ms"))
    return F.to_json(envelope)


def order_messages(orders):
    """Change messages of a frame (or stream) of orders."""
    topic = F.lit("server.sales.orders")
    made = [F.when(F.expr(cond), F.struct(topic.alias("topic"), _message(op, lsn, status).alias("value")))
            for cond, op, lsn, status, _ in CHANGE_STATES]
    made.append(F.when(F.expr("o_orderkey % 11 = 0"), F.struct(topic.alias("topic"), F.lit(None).cast("string").alias("value"))))
    made.append(F.when(F.expr("o_orderkey % 100 = 1"), F.struct(
        F.lit("server.public._dbz_heartbeat").alias("topic"), F.lit('{"ts_ms": 1}').alias("value"))))
    made.append(F.when(F.expr("o_orderkey % 100 = 2"), F.struct(topic.alias("topic"), F.lit('{"op": "c", ').alias("value"))))
    rows = orders.select((F.col("o_custkey") % 4).cast("int").alias("partition"), F.col("o_orderkey").alias("offset"),
                         F.explode(F.array_compact(F.array(*made))).alias("m"))
    return rows.select("m.topic", "partition", "offset", "m.value")


_CHANGES = " UNION ALL ".join(
    f"SELECT o_orderkey, o_custkey, '{status}' AS o_orderstatus, o_totalprice, o_orderkey + {lsn} AS version, "
    f"{'true' if op == 'd' else 'false'} AS is_deleted FROM {{orders}} WHERE {cond}"
    for cond, op, lsn, status, _ in CHANGE_STATES)


@query("unwrap_changes_orders", _CHANGES)
def unwrap_changes_orders(t: Tables):
    good, _ = changes.split_bad(order_messages(t.orders))
    return changes.unwrap_changes(good, ORDER_ROW)


@query("route_changes_orders", """
SELECT 'cdc_shop_' || replace(o_orderpriority, '-', '_') || '_t' || CAST(o_orderkey % 5 AS VARCHAR) AS table_name,
  count(*) AS row_count FROM (SELECT replace(replace(o_orderpriority, ' ', '_'), '-', '_') AS o_orderpriority, o_orderkey FROM {orders}) GROUP BY 1""")
def route_changes_orders(t: Tables):
    topic = F.concat(F.lit("srv1."), F.col("o_orderpriority"), F.lit(".t"), (F.col("o_orderkey") % 5).cast("string"))
    return t.orders.groupBy(changes.route_table(topic, "shop").alias("table_name")).agg(F.count(F.lit(1)).alias("row_count"))


def _landed(t: Tables) -> str:
    """A file stream of orders turned into messages, landed."""
    path = t.scratch("landing")
    stream = t.spark.readStream.schema(t.orders.schema).option("pathGlobFilter", "orders.parquet").parquet(t.folder)
    changes.land_changes(order_messages(stream), f"{path}/rows", f"{path}/checkpoint").awaitTermination()
    return f"{path}/rows"


@query("land_changes_orders", f"SELECT 'cdc_db_sales_orders' AS table_name, * FROM ({_CHANGES})")
def land_changes_orders(t: Tables):
    landed = changes.read_landing(t.spark, _landed(t), "cdc_db_sales_orders")
    return changes.unwrap_changes(landed, ORDER_ROW, keep=["table_name"])


@query("two_streams_one_landing", f"SELECT 'cdc_db_sales_orders' AS table_name, * FROM ({_CHANGES})")
def two_streams_one_landing(t: Tables):
    """Two streams, each with a checkpoint of its own, share a landing folder."""
    path = t.scratch("shared")
    for i in range(2):
        stream = t.spark.readStream.schema(t.orders.schema).option("pathGlobFilter", "orders.parquet").parquet(t.folder)
        half = order_messages(stream).filter(F.col("offset") % 2 == i)
        changes.land_changes(half, f"{path}/landing", f"{path}/checkpoint-{i}").awaitTermination()
    landed = changes.read_landing(t.spark, f"{path}/landing", "cdc_db_sales_orders")
    return changes.unwrap_changes(landed, ORDER_ROW, keep=["table_name"])


@query("overlapping_reads_land_once", f"SELECT 'cdc_db_sales_orders' AS table_name, * FROM ({_CHANGES})")
def overlapping_reads_land_once(t: Tables):
    """Two reads of two thirds of the messages each, the second under a checkpoint of its own."""
    path = t.scratch("once")
    # The messages of an order share an offset; here each has its own.
    kind = F.when(F.col("value").isNull(), 3).when(F.col("value") == '{"op": "c", ', 4).when(F.col("value").startswith('{"op":"u"'), 1) \
        .when(F.col("value").startswith('{"op":"d"'), 2).otherwise(0)
    for i, part in enumerate(("offset % 3 < 2", "offset % 3 > 0")):
        stream = t.spark.readStream.schema(t.orders.schema).option("pathGlobFilter", "orders.parquet").parquet(t.folder)
        messages = order_messages(stream).withColumn("offset", F.col("offset") * 8 + kind)
        changes.land_changes(messages.filter(part), f"{path}/landing", f"{path}/checkpoint-{i}",
                             row_schemas={"cdc_db_sales_orders": ORDER_ROW}, offsets=f"{path}/offsets").awaitTermination()
    landed = changes.read_landing(t.spark, f"{path}/landing", "cdc_db_sales_orders")
    return changes.unwrap_changes(landed, ORDER_ROW, keep=["table_name"])


@query("dead_letters_of_stream", """
SELECT o_orderkey AS "offset", 'value is not JSON' AS error, true AS timed FROM {orders} WHERE o_orderkey % 100 = 2""")
def dead_letters_of_stream(t: Tables):
    return changes.read_dead(t.spark, _landed(t)).select("offset", "error", F.col("failed_at").isNotNull().alias("timed"))


@query("upsert_stream_orders", """
SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 7 = 0 THEN 'F' ELSE 'O' END AS o_orderstatus
FROM {orders} WHERE o_orderkey % 11 <> 0""")
def upsert_stream_orders(t: Tables):
    path = t.scratch("upsert")
    stream = t.spark.readStream.schema(t.orders.schema).option("pathGlobFilter", "orders.parquet").parquet(t.folder)
    good, _ = changes.split_bad(order_messages(stream))
    changes.upsert_stream(changes.unwrap_changes(good, ORDER_ROW), f"{path}/table", ["o_orderkey"],
                          f"{path}/checkpoint").awaitTermination()
    return versioned.read_upserted(t.spark, f"{path}/table").select("o_orderkey", "o_custkey", "o_orderstatus")


@query("dead_letter_orders", """
SELECT o_orderkey AS "offset", CASE WHEN o_orderkey % 200 = 2 THEN 'replayed' ELSE 'dead' END AS state
FROM {orders} WHERE o_orderkey % 100 = 2""")
def dead_letter_orders(t: Tables):
    _, dead = changes.split_bad(order_messages(t.orders))
    repaired = F.when(F.col("offset") % 200 == 2, F.concat(F.rtrim("value"), F.lit('"x": 1}'))).otherwise(F.col("value"))
    good, still = changes.replay(dead, repaired)
    return good.select("offset", F.lit("replayed").alias("state")).unionByName(
        still.select("offset", F.lit("dead").alias("state")))


@query("current_orders_from_changes", """
SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'F' ELSE 'O' END AS o_orderstatus, o_totalprice
FROM {orders} WHERE o_orderkey % 11 <> 0""")
def current_orders_from_changes(t: Tables):
    good, _ = changes.split_bad(order_messages(t.orders))
    rows = changes.unwrap_changes(good, ORDER_ROW)
    return versioned.current_view(rows, ["o_orderkey"]).select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("backfill_orders", """
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'changed' ELSE o_orderstatus END AS o_orderstatus,
  CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey + 1 ELSE 0 END AS version,
  strftime(CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate WHEN o_orderkey % 3 = 0 THEN TIMESTAMP '1970-01-01 09:30:00'
    ELSE o_orderdate END, '%Y-%m-%d %H:%M:%S') AS o_orderdate FROM {orders}""")
def backfill_orders(t: Tables):
    """Backfilled rows fill the odd keys and never beat the changes on the even ones."""
    landing = t.orders.filter("o_orderkey % 2 = 0").select(
        "o_orderkey", F.lit("changed").alias("o_orderstatus"), "o_orderdate",
        (F.col("o_orderkey") + 1).alias("version"), F.lit(False).alias("is_deleted"))
    text = F.when(F.col("o_orderkey") % 3 == 0, F.lit("9:30")).otherwise(F.col("o_orderdate").cast("string"))
    source = t.orders.select(F.col("o_orderkey").alias("O_ORDERKEY"), "o_orderstatus", text.alias("o_orderdate"), "o_custkey")
    rows = landing.unionByName(changes.backfill(source, landing))
    latest = versioned.latest_version(rows, ["o_orderkey"]).drop("is_deleted")
    return latest.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))


_MOVED = "o_orderdate + INTERVAL (CASE o_orderkey % 4 WHEN 0 THEN -60 WHEN 1 THEN 0 WHEN 2 THEN 160 ELSE 110 END) YEAR"


@query("clamp_dates_orders", f"""
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 AND o_orderkey % 3 = 0 THEN NULL ELSE
  strftime(CASE WHEN year(x) < 1970 THEN TIMESTAMP '1970-01-01' WHEN year(x) > 2105 THEN TIMESTAMP '2105-12-31 23:59:59' ELSE x END,
  '%Y-%m-%d %H:%M:%S') END AS stamp,
  CAST(CASE WHEN year(x) < 1970 THEN DATE '1970-01-01' WHEN year(x) > 2148 THEN DATE '2148-12-31' ELSE CAST(x AS DATE) END AS VARCHAR) AS day
FROM (SELECT o_orderkey, {_MOVED} AS x FROM {{orders}})""")
def clamp_dates_orders(t: Tables):
    years = F.when(F.col("o_orderkey") % 4 == 0, -60).when(F.col("o_orderkey") % 4 == 1, 0) \
        .when(F.col("o_orderkey") % 4 == 2, 160).otherwise(110)
    moved = t.orders.select("o_orderkey", (F.col("o_orderdate") + F.make_ym_interval(years)).alias("x"))
    rows = moved.select("o_orderkey", F.when((F.col("o_orderkey") % 4 != 3) | (F.col("o_orderkey") % 3 != 0), F.col("x")).alias("stamp"),
                        F.col("x").cast("date").alias("day"))
    return values.clamp_dates(rows).select(
        "o_orderkey", F.date_format("stamp", "yyyy-MM-dd HH:mm:ss").alias("stamp"), F.col("day").cast("string").alias("day"))


_CLOCK = """CASE event_id % 4 WHEN 0 THEN CAST(event_id % 24 AS {text}) || ':05'
  WHEN 1 THEN '09:' || CAST(10 + event_id % 50 AS {text}) || ':' || CAST(10 + event_id % 50 AS {text})
  WHEN 2 THEN '23:59:59.5' ELSE 'soon' END"""


@query("time_to_timestamp_events", f"""
SELECT event_id, strftime(TRY_CAST('1970-01-01 ' || CASE WHEN c LIKE '_:%' THEN '0' || c ELSE c END ||
   CASE WHEN length(c) <= 5 AND c LIKE '%:05' THEN ':00' ELSE '' END AS TIMESTAMP), '%Y-%m-%d %H:%M:%S.%g') AS stamp
FROM (SELECT event_id, {_CLOCK.replace('{text}', 'VARCHAR')} AS c FROM {{events}})""")
def time_to_timestamp_events(t: Tables):
    clock = t.sql(f"SELECT event_id, {_CLOCK.replace('{text}', 'STRING')} AS c FROM {{events}}")
    return clock.select("event_id", F.date_format(values.time_to_timestamp(F.col("c")), "yyyy-MM-dd HH:mm:ss.SSS").alias("stamp"))


@query("decode_epoch_events", """
SELECT event_id, CAST(DATE '1970-01-01' + CAST(event_id AS INTEGER) AS VARCHAR) AS from_days,
  CAST(CAST(epoch_ms(event_id * 86400000 * 3) AS DATE) AS VARCHAR) AS from_millis FROM {events}""")
def decode_epoch_events(t: Tables):
    return t.events.select(
        "event_id", values.decode_epoch(F.col("event_id"), "days").cast("string").alias("from_days"),
        values.decode_epoch(F.col("event_id") * 86400000 * 3, "millis").cast("string").alias("from_millis"))


@query("json_extract_events", """
SELECT event_id, CAST(props AS JSON) ->> 'k' AS k, CAST(props AS JSON) ->> 'none' AS absent,
  CAST('["a", ' || CAST(event_id AS VARCHAR) || ']' AS JSON) ->> 1 AS second FROM {events}""")
def json_extract_events(t: Tables):
    pair = F.concat(F.lit('["a", '), F.col("event_id").cast("string"), F.lit("]"))
    return t.events.select("event_id", js.json_get(F.col("props"), "k").alias("k"),
                           js.json_get(F.col("props"), "none").alias("absent"), js.json_get(pair, 1).alias("second"))


# ---------------------------------------------------------------- warehouse refresh


def sales_query(views):
    """Orders with their customer, if there is one."""
    o, c = views["orders"], views["customer"]
    return o.join(c, o["o_custkey"] == c["c_custkey"], "left").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "c_name", "c_mktsegment")


SALES = warehouse.Warehouse(
    query=sales_query, keys=["o_orderkey"],
    table_keys={"orders": ["o_orderkey"], "customer": ["c_custkey"]},
    links={"orders": ["o_orderkey"], "customer": ["o_custkey"]})

_FINAL_ORDERS = "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 7 = 0 THEN 'F' ELSE 'O' END AS o_orderstatus FROM {orders} WHERE o_orderkey % 11 <> 0"
_FINAL_CUSTOMERS = "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'new ' || c_name ELSE c_name END AS c_name, c_mktsegment FROM {customer} WHERE c_custkey % 13 <> 0"
_FINAL_SALES = f"SELECT o_orderkey, o_custkey, o_orderstatus, c_name, c_mktsegment FROM ({_FINAL_ORDERS}) LEFT JOIN ({_FINAL_CUSTOMERS}) ON o_custkey = c_custkey"


def _sales_batches(t: Tables):
    """Changes of both tables in three batches: creation, updates, deletes."""
    def orders(cond, status, version, deleted=False):
        return t.orders.filter(cond).select(
            "o_orderkey", "o_custkey", F.lit(status).alias("o_orderstatus"), F.lit(version).cast("long").alias("version"),
            F.lit(deleted).alias("is_deleted"))

    def customers(cond, prefix, version, deleted=False):
        return t.customer.filter(cond).select(
            "c_custkey", F.concat(F.lit(prefix), "c_name").alias("c_name"), "c_mktsegment",
            F.lit(version).cast("long").alias("version"), F.lit(deleted).alias("is_deleted"))

    return [
        {"orders": orders("true", "O", 1), "customer": customers("c_custkey % 3 <> 0", "", 1)},
        {"orders": orders("o_orderkey % 7 = 0", "F", 2), "customer": customers("c_custkey % 3 = 0", "", 1)},
        {"customer": customers("c_custkey % 5 = 0", "new ", 3)},
        {"orders": orders("o_orderkey % 11 = 0", "F", 4, True), "customer": customers("c_custkey % 13 = 0", "", 4, True)},
    ]


@query("join_refresh_orders_customer", _FINAL_SALES)
def join_refresh_orders_customer(t: Tables):
    """The target after four incremental refreshes equals the query over the final tables."""
    path = t.scratch("warehouse")
    target = None
    for number, batch in enumerate(_sales_batches(t), 1):
        for table, rows in batch.items():
            rows.withColumn("ingest_seq", F.lit(number).cast("long")).write.parquet(f"{path}/{table}/batch={number}")
        landing = {table: t.spark.read.parquet(f"{path}/{table}/batch=*") for table in SALES.table_keys}
        changed = {table: t.spark.read.parquet(f"{path}/{table}/batch={number}") for table in batch}
        warehouse.join_refresh(changed, landing, target, SALES, number).write.parquet(f"{path}/target/batch={number}")
        target = t.spark.read.parquet(f"{path}/target/batch=*")
    final = versioned.current_view(target, SALES.keys, sequence=None)
    return final.select("o_orderkey", "o_custkey", "o_orderstatus", "c_name", "c_mktsegment")


def _sales_nation(views):
    """Orders with their customer and its nation, if there are."""
    o, c, n = views["orders"], views["customer"], views["nation"]
    joined = o.join(c, o["o_custkey"] == c["c_custkey"], "left").join(n, F.col("c_nationkey") == n["n_nationkey"], "left")
    return joined.select("o_orderkey", "o_orderstatus", "c_name", "n_name")


CHAIN = buckets.BucketedWarehouse(
    query=_sales_nation, keys=["o_orderkey"], driving="orders",
    table_keys={"orders": ["o_orderkey"], "customer": ["c_custkey"], "nation": ["n_nationkey"]},
    links=[buckets.Link("orders", ["o_custkey"], "customer"), buckets.Link("customer", ["c_nationkey"], "nation")], buckets=32)


@query("join_refresh_buckets", f"""
SELECT o_orderkey, o_orderstatus, c_name, n_name FROM ({_FINAL_ORDERS}) LEFT JOIN (
  SELECT f.c_custkey, f.c_name, c.c_nationkey FROM ({_FINAL_CUSTOMERS}) f JOIN {{customer}} c USING (c_custkey)) ON o_custkey = c_custkey
LEFT JOIN (SELECT n_nationkey, CASE WHEN n_nationkey = 3 THEN 'new ' || n_name ELSE n_name END AS n_name FROM {{nation}} WHERE n_nationkey <> 7)
  ON c_nationkey = n_nationkey""")
def join_refresh_buckets(t: Tables):
    """Four batches over two hops, from bucketed state: changes of nations reach orders over customers."""
    path, home = t.scratch("buckets"), t.customer.select(F.col("c_custkey").alias("k"), "c_nationkey")
    stamp = lambda df, version, gone=False: df.withColumns({"version": F.lit(version).cast("long"), "is_deleted": F.lit(gone)})
    nations = t.nation.select("n_nationkey", "n_name")
    moved = nations.filter("n_nationkey = 3").withColumn("n_name", F.concat(F.lit("new "), "n_name"))
    more = {1: stamp(nations, 1), 3: stamp(moved, 3), 4: stamp(nations.filter("n_nationkey = 7"), 4, True)}
    for number, batch in enumerate(_sales_batches(t), 1):
        changed = dict(batch)
        changed["customer"] = batch["customer"].drop("c_mktsegment").join(home, F.col("c_custkey") == F.col("k")).drop("k")
        if number in more:
            changed["nation"] = more[number]
        buckets.refresh(t.spark, path, CHAIN, changed, number)
    return buckets.read_target(t.spark, path, CHAIN)


@query("initial_populate_orders_customer", f"SELECT *, CAST(0 AS BIGINT) AS version FROM ({_FINAL_SALES})")
def initial_populate_orders_customer(t: Tables):
    parts = {table: None for table in SALES.table_keys}
    for number, batch in enumerate(_sales_batches(t), 1):
        for table, rows in batch.items():
            rows = rows.withColumn("ingest_seq", F.lit(number).cast("long"))
            parts[table] = rows if parts[table] is None else parts[table].unionByName(rows)
    return warehouse.populate(parts, SALES).drop("sync_dt", "is_deleted")


@query("resync_missing_orders", """
SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 2 = 0 THEN 'kept' ELSE o_orderstatus END AS o_orderstatus,
  c_name, c_mktsegment FROM {orders} LEFT JOIN {customer} ON o_custkey = c_custkey""")
def resync_missing_orders(t: Tables):
    """Half of the target is lost; the resync brings it back and keeps the newer half."""
    def as_landing(df):
        return df.withColumns({"version": F.lit(1).cast("long"), "is_deleted": F.lit(False), "ingest_seq": F.lit(1).cast("long")})

    landing = {"orders": as_landing(t.orders.select("o_orderkey", "o_custkey", "o_orderstatus")),
               "customer": as_landing(t.customer.select("c_custkey", "c_name", "c_mktsegment"))}
    half = warehouse.populate(landing, SALES).filter("o_orderkey % 2 = 0").withColumns(
        {"version": F.lit(5).cast("long"), "o_orderstatus": F.lit("kept")})
    path = t.scratch("resync")
    snapshots.write_snapshot(warehouse.resync("missing", landing, half, SALES), path)
    return snapshots.read_snapshot(t.spark, path).drop("sync_dt", "version", "is_deleted")


@query("resync_full_orders", """
SELECT o_orderkey, o_custkey, o_orderstatus, c_name, c_mktsegment FROM {orders} LEFT JOIN {customer} ON o_custkey = c_custkey""")
def resync_full_orders(t: Tables):
    """A target that is out of step is filled anew."""
    def as_landing(df):
        return df.withColumns({"version": F.lit(1).cast("long"), "is_deleted": F.lit(False), "ingest_seq": F.lit(1).cast("long")})

    landing = {"orders": as_landing(t.orders.select("o_orderkey", "o_custkey", "o_orderstatus")),
               "customer": as_landing(t.customer.select("c_custkey", "c_name", "c_mktsegment"))}
    wrong = warehouse.populate(landing, SALES).filter("o_orderkey % 2 = 0").withColumn("o_orderstatus", F.lit("wrong"))
    return warehouse.resync("full", landing, wrong, SALES).drop("sync_dt", "version", "is_deleted")


@query("read_changes_orders", f"SELECT 'cdc_db_sales_orders' AS table_name, * FROM ({_CHANGES})")
def read_changes_orders(t: Tables):
    """Messages in files, read as a stream and landed."""
    path = t.scratch("messages")
    order_messages(t.orders).write.json(f"{path}/files", ignoreNullFields=False)
    stream = changes.read_changes(t.spark, f"{path}/files", maxFilesPerTrigger=2)
    changes.land_changes(stream, f"{path}/rows", f"{path}/checkpoint").awaitTermination()
    return changes.unwrap_changes(changes.read_landing(t.spark, f"{path}/rows", "cdc_db_sales_orders"), ORDER_ROW, keep=["table_name"])


@query("row_or_dead_letter", f"""
SELECT 'row' AS state, NULL AS error, count(*) AS message_count FROM ({_CHANGES})
UNION ALL SELECT 'dead', 'value is not JSON', count(*) FROM {{orders}} WHERE o_orderkey % 100 = 2
UNION ALL SELECT 'dead', 'event does not fit the table', 3 * count(*) FROM {{orders}} WHERE o_orderkey % 9 = 0""")
def row_or_dead_letter(t: Tables):
    """Events with a wrong type, without a row, or of another shape are set aside, not lost."""
    wrong = F.array(F.lit('{"op": "c", "after": {"o_orderkey": "oops"}}'), F.lit('{"op": "c"}'), F.lit("[1]"))
    misfits = t.orders.filter("o_orderkey % 9 = 0").select(
        F.lit("server.sales.orders").alias("topic"), F.lit(0).alias("partition"), F.col("o_orderkey").alias("offset"), F.explode(wrong).alias("value"))
    good, dead = changes.split_bad(order_messages(t.orders).unionByName(misfits), row_schema=ORDER_ROW)
    rows = changes.unwrap_changes(good, ORDER_ROW).select(F.lit("row").alias("state"), F.lit(None).cast("string").alias("error"))
    return rows.union(dead.select(F.lit("dead"), "error")).groupBy("state", "error").agg(F.count(F.lit(1)).alias("message_count"))


@query("stream_warehouse_orders", """
SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 7 = 0 THEN 'F' ELSE 'O' END AS o_orderstatus,
  CASE WHEN o_custkey % 2 = 0 THEN 'even' ELSE 'odd' END AS c_name, CAST(NULL AS VARCHAR) AS c_mktsegment FROM {orders} WHERE o_orderkey % 11 <> 0""")
def stream_warehouse_orders(t: Tables):
    """Change messages of orders stream into landing and a refreshed target."""
    path = t.scratch("stream")
    stream = t.spark.readStream.schema(t.orders.schema).option("pathGlobFilter", "orders.parquet").parquet(t.folder)

    def split(batch):
        good, _ = changes.split_bad(batch)
        orders = changes.unwrap_changes(good, ORDER_ROW).select(
            "o_orderkey", "o_custkey", "o_orderstatus", "version", "is_deleted")
        customer = orders.select(
            F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_custkey") % 2 == 0, "even").otherwise("odd").alias("c_name"),
            F.lit(None).cast("string").alias("c_mktsegment"), F.lit(1).cast("long").alias("version"), F.lit(False).alias("is_deleted"))
        return {"orders": orders, "customer": customer}

    warehouse.run_warehouse(order_messages(stream), split, SALES, f"{path}/landing", f"{path}/target",
                            f"{path}/checkpoint").awaitTermination()
    target = t.spark.read.parquet(f"{path}/target/batch=*")
    return versioned.current_view(target, SALES.keys, sequence=None).select(
        "o_orderkey", "o_custkey", "o_orderstatus", "c_name", "c_mktsegment")


@query("add_source_customer", """
SELECT 'first' AS source_db, c_custkey, c_name FROM {customer} WHERE c_custkey % 2 = 0 AND c_custkey % 10 <> 0
UNION ALL SELECT 'second', c_custkey, c_name FROM {customer} WHERE c_custkey % 3 = 0""")
def add_source_customer(t: Tables):
    landing = t.customer.filter("c_custkey % 2 = 0").select("c_custkey", "c_name").withColumns(
        {"version": F.lit(9).cast("long"), "is_deleted": F.lit(False)})
    gone = landing.filter("c_custkey % 10 = 0").withColumns({"version": F.lit(12).cast("long"), "is_deleted": F.lit(True)})
    landing = landing.unionByName(gone)
    source = t.customer.filter("c_custkey % 3 = 0").select("c_custkey", "c_name", "c_acctbal")
    sources = warehouse.add_source({"first": landing}, "second", source, landing)
    return versioned.consolidate(sources, keys=["c_custkey"], sequence=None).select("source_db", "c_custkey", "c_name")


# ---------------------------------------------------------------- delayed retries

@query("retry_stream_events", """
WITH failed AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS round, max(ts) AS failed_at, arg_max(event_id, (ts, event_id)) AS event_id
  FROM {events} WHERE event_type = 'error' GROUP BY ALL)
SELECT CAST(user_id AS VARCHAR) || '@' || CAST(day AS VARCHAR) AS task, CAST(event_id AS VARCHAR) AS payload, CAST(round AS INTEGER) AS round,
  CASE WHEN round < 3 THEN 'RETRY' ELSE 'DEAD' END AS outcome, CASE WHEN round < 3 THEN failed_at + INTERVAL 60 SECOND ELSE failed_at END AS "at"
FROM failed WHERE round >= 3 OR failed_at + INTERVAL 60 SECOND <= (SELECT date_trunc('millisecond', max(failed_at)) FROM failed)""")
def retry_stream_events(t: Tables):
    """A user's errors of a day are the rounds of one task; two runs of one stream, the second after a restart."""
    path = t.scratch("retries")
    errors = t.events.filter("event_type = 'error'").withColumn("day", F.to_date("ts"))
    failed = ranking.rank_rows(errors, ["user_id", "day"], ["ts", "event_id"], "nth").select(
        F.concat_ws("@", "user_id", "day").alias("task"), (F.col("nth") - 1).cast("int").alias("round"),
        F.col("ts").cast("timestamp").alias("failed_at"), F.col("event_id").cast("string").alias("payload"), "day")
    for i, part in enumerate(("day < '2024-01-15'", "day >= '2024-01-15'")):
        failed.filter(part).drop("day").write.parquet(f"{path}/failed/{i}")
        stream = t.spark.readStream.schema(failed.drop("day").schema).parquet(f"{path}/failed/*")
        out = retries.retry_stream(stream)
        writer = out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint") \
            .trigger(availableNow=True)
        retries.start_retries(writer, t.spark).awaitTermination()
    return t.spark.read.schema(out.schema).parquet(f"{path}/out").withColumn("at", F.col("at").cast("timestamp_ntz"))
