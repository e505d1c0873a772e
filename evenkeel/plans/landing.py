"""JSON landing, flattening, event rules and statuses."""

from __future__ import annotations

from pyspark.sql import functions as F

from evenkeel.functions import json as js
from evenkeel.functions.events import path_values
from evenkeel.operators import diff, jsonland, schema
from evenkeel.plans.base import Tables, query

# Payloads of every shape the landing has to take.
PAYLOADS = """
SELECT event_id, CASE event_id % 8
  WHEN 0 THEN props
  WHEN 1 THEN '[' || props || ',  1 ]'
  WHEN 2 THEN '"' || replace(props, '"', '\\"') || '"'
  WHEN 3 THEN CAST(event_id AS {text})
  WHEN 4 THEN 'say "' || event_type || '" now'
  WHEN 5 THEN '   '
  WHEN 6 THEN ' true '
  ELSE NULL END AS payload FROM {events}
"""
PAYLOADS_SPARK = PAYLOADS.replace("{text}", "STRING").replace("\\\"'", "\\\\\"'")
PAYLOADS_CHECK = PAYLOADS.replace("{text}", "VARCHAR")


@query("bundle_payload_events", f"""
SELECT p.event_id, CASE p.event_id % 8 WHEN 0 THEN '[' || props || ']' WHEN 1 THEN payload WHEN 2 THEN '[' || props || ']'
  WHEN 3 THEN '[' || payload || ']' WHEN 4 THEN '["' || replace(payload, '"', '\\"') || '"]' WHEN 6 THEN '[true]'
  ELSE '[{{}}]' END AS detail_data
FROM ({PAYLOADS_CHECK}) p JOIN {{events}} e ON p.event_id = e.event_id""")
def bundle_payload_events(t: Tables):
    return t.sql(PAYLOADS_SPARK).select("event_id", js.bundle_payload(F.col("payload")).alias("detail_data"))


@query("land_json_events", f"""
SELECT 'EVT' AS kode_data, 'evenkeel' AS input_by, '2023-11-14 22:13:20' AS input_dt, count(*) AS row_count,
  count(*) AS seq_count, true AS seq_in_batch FROM ({PAYLOADS_CHECK}) WHERE trim(payload) <> ''""")
def land_json_events(t: Tables):
    landed = jsonland.land_json(t.sql(PAYLOADS_SPARK), code="EVT", batch_millis=1700000000000)
    assert schema.check_landing_schema(landed) == []
    return landed.groupBy("kode_data", "input_by", F.date_format("input_dt", "yyyy-MM-dd HH:mm:ss").alias("input_dt")).agg(
        F.count(F.lit(1)).alias("row_count"), F.countDistinct("seq").alias("seq_count"),
        (F.min("seq") >= 1700000000000 * 1000).alias("seq_in_batch"))


# One landing row per user and type, holding its events as a list.
ITEM = """'{"id": ' || CAST(event_id AS {text}) || ', "amount": ' || CAST(value AS {text}) || ', "vip": ' ||
  CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END || ', "note": "' || event_type || '", "qty": "' ||
  CASE WHEN event_id % 5 = 0 THEN 'many' ELSE CAST(event_id % 9 AS {text}) END || '"' ||
  CASE WHEN event_id % 3 = 0 THEN '' ELSE ', "tags": ["a"]' END || '}'"""


def items_landing(t: Tables):
    item = t.sql("SELECT user_id, event_type, event_id, " + ITEM.replace("{text}", "STRING") + " AS item FROM {events}")
    # Lists of bounded length: one landing row per user, type and hundred of event ids.
    lists = item.groupBy("user_id", "event_type", F.floor(F.col("event_id") / 100).alias("part")).agg(
        F.array_join(F.array_sort(F.collect_list("item")), ",").alias("items"))
    return lists.select(
        F.monotonically_increasing_id().alias("seq"), F.col("event_type").alias("kode_data"),
        F.concat(F.lit('[{"data": ['), F.col("items"), F.lit("]}]")).alias("detail_data"))


ITEM_FIELDS = [
    {"name": "id", "type": "UInt64"}, {"name": "amount", "type": "Float64"}, {"name": "vip", "type": "Bool"},
    {"name": "the note", "type": "String", "jsonKey": "note"}, {"name": "qty", "type": "Int64"},
    {"name": "tags", "type": "String"}, {"name": "absent", "type": "String"},
]


@query("flatten_items_events", """
SELECT event_type AS kode_data, event_id AS id, value AS amount, event_id % 2 = 0 AS vip, event_type AS the_note,
  CASE WHEN event_id % 5 = 0 THEN 0 ELSE event_id % 9 END AS qty, CASE WHEN event_id % 3 = 0 THEN '' ELSE '["a"]' END AS tags,
  '' AS absent FROM {events} WHERE event_type = 'purchase'""")
def flatten_items_events(t: Tables):
    return jsonland.flatten_items(items_landing(t), "purchase", ITEM_FIELDS).drop("sync_dt")


@query("flatten_dedupe_events", """
SELECT the_note, qty, id FROM (SELECT event_type AS the_note, CASE WHEN event_id % 5 = 0 THEN 0 ELSE event_id % 9 END AS qty,
  event_id AS id FROM {events} WHERE event_type = 'view') QUALIFY row_number() OVER (PARTITION BY the_note, qty ORDER BY id DESC) = 1""")
def flatten_dedupe_events(t: Tables):
    rows = jsonland.flatten_items(items_landing(t), "view", ITEM_FIELDS).select("the_note", "qty", "id")
    return diff.dedupe_last(rows, ["the_note", "qty"], ["id"])


@query("land_json_twice", f"""
SELECT 2 * count(*) AS row_count, 2 * count(*) AS seq_count FROM ({PAYLOADS_CHECK}) WHERE trim(payload) <> ''""")
def land_json_twice(t: Tables):
    """Two batches a millisecond apart never share a number."""
    first = jsonland.land_json(t.sql(PAYLOADS_SPARK), batch_millis=1700000000000)
    second = jsonland.land_json(t.sql(PAYLOADS_SPARK), batch_millis=1700000000001, above=jsonland.highest_seq(first))
    return first.union(second).agg(F.count(F.lit(1)).alias("row_count"), F.countDistinct("seq").alias("seq_count"))


@query("infer_json_schema_events", """
SELECT unnest(['id', 'amount', 'vip', 'note', 'qty', 'tags']) AS name,
  unnest(['Int64', 'Float64', 'Bool', 'String', 'String', 'String']) AS type, unnest([n, n, n, n, n, n]) AS found
FROM (SELECT count(*) > 0 AS n FROM {events})""")
def infer_json_schema_events(t: Tables):
    return jsonland.infer_json_schema(items_landing(t)).withColumn("found", F.lit(True))


# Events with orders at several depths, under names of several styles.
EVENT_BODY = """CASE event_id % 6
  WHEN 0 THEN '{"order_status": "PAID", "orderId": "A' || CAST(event_id AS {text}) || '"}'
  WHEN 1 THEN '{"payload": {"orderStatus": "paid ", "orderId": "B' || CAST(event_id AS {text}) || '"}}'
  WHEN 2 THEN '{"data": [{"orderStatus": "Shipped", "order_id": "C' || CAST(event_id AS {text}) || '"}, {"status": "x", "order_id": "D' || CAST(event_id AS {text}) || '"}]}'
  WHEN 3 THEN '{"data": "{\\"orderStatus\\": \\"PAID\\", \\"orderId\\": \\"E' || CAST(event_id AS {text}) || '\\"}"}'
  WHEN 4 THEN '[{"orders": [{"ORDERSTATUS": "Paid", "orderid": ' || CAST(event_id AS {text}) || '}]}]'
  ELSE 'not json' END"""


def events_with_orders(t: Tables):
    text = EVENT_BODY.replace("{text}", "STRING").replace('\\"', '\\\\"')
    return t.sql(f"SELECT event_id, {text} AS payload FROM {{events}}")


# The matching objects of each event, as JSON: for boxed text both the outer object and the inner one.
_NODES = """
SELECT event_id, '{"orderId":"A' || CAST(event_id AS VARCHAR) || '","order_status":"PAID"}' AS node FROM {events} WHERE event_id % 6 = 0
UNION ALL SELECT event_id, '{"payload":{"orderId":"B' || CAST(event_id AS VARCHAR) || '","orderStatus":"paid "}}' FROM {events} WHERE event_id % 6 = 1
UNION ALL SELECT event_id, '{"data":"{\\"orderStatus\\": \\"PAID\\", \\"orderId\\": \\"E' || CAST(event_id AS VARCHAR) || '\\"}"}' FROM {events} WHERE event_id % 6 = 3
UNION ALL SELECT event_id, '{"orderId":"E' || CAST(event_id AS VARCHAR) || '","orderStatus":"PAID"}' FROM {events} WHERE event_id % 6 = 3
UNION ALL SELECT event_id, '{"ORDERSTATUS":"Paid","orderid":' || CAST(event_id AS VARCHAR) || '}' FROM {events} WHERE event_id % 6 = 4"""


@query("match_events_orders", _NODES)
def match_events_orders(t: Tables):
    found = jsonland.match_events(events_with_orders(t), [{"key": "orderStatus", "value": "paid, done"}, {"key": "any", "value": "*"}])
    return found.select("event_id", "node")


@query("path_value_events", """
SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'PAID' WHEN 1 THEN 'paid ' WHEN 3 THEN 'PAID' ELSE '' END AS status,
  CASE event_id % 6 WHEN 2 THEN 'C' || CAST(event_id AS VARCHAR) ELSE '' END AS first_id,
  CASE event_id % 6 WHEN 2 THEN 'D' || CAST(event_id AS VARCHAR) ELSE '' END AS second_id,
  CASE event_id % 6 WHEN 4 THEN CAST(event_id AS VARCHAR) ELSE '' END AS listed_id FROM {events}""")
def path_value_events(t: Tables):
    return path_values(events_with_orders(t), "payload", {
        "status": "orderStatus", "first_id": "data.orderId", "second_id": "data[1].order_id", "listed_id": "orders[0].orderId"}).drop("payload")


@query("extract_params_events", """
SELECT event_id, 'A' || CAST(event_id AS VARCHAR) AS order_id, 'PAID' AS state, 'A' || CAST(event_id AS VARCHAR) AS pk FROM {events} WHERE event_id % 6 = 0
UNION ALL SELECT event_id, 'B' || CAST(event_id AS VARCHAR), 'paid', 'B' || CAST(event_id AS VARCHAR) FROM {events} WHERE event_id % 6 = 1
UNION ALL SELECT event_id, 'E' || CAST(event_id AS VARCHAR), 'PAID', 'E' || CAST(event_id AS VARCHAR) FROM {events} WHERE event_id % 6 = 3
UNION ALL SELECT event_id, CAST(event_id AS VARCHAR), 'Paid', CAST(event_id AS VARCHAR) FROM {events} WHERE event_id % 6 = 4""")
def extract_params_events(t: Tables):
    return jsonland.extract_params(
        events_with_orders(t), [{"key": "order_status", "value": "PAID"}],
        [{"target": "order_id", "source": "orderId"}, {"target": "state", "source": "orderStatus"}], by=["event_id"]).drop("value", "orderId")


_IDS = """SELECT CASE event_id % 6 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' END || CAST(event_id AS VARCHAR) AS order_id
  FROM {events} WHERE event_id % 6 < 3"""


@query("collect_ids_events", f"SELECT DISTINCT order_id FROM ({_IDS})")
def collect_ids_events(t: Tables):
    return jsonland.order_ids(events_with_orders(t), "paid,SHIPPED")


@query("id_batches_events", f"""
SELECT CAST(floor((rn - 1) / 50) AS BIGINT) AS batch, count(*) AS id_count, min(order_id) AS first_id, max(order_id) AS last_id
FROM (SELECT order_id, row_number() OVER (ORDER BY order_id) AS rn FROM (SELECT DISTINCT order_id FROM ({_IDS}))) GROUP BY 1""")
def id_batches_events(t: Tables):
    return jsonland.id_batches(jsonland.order_ids(events_with_orders(t), "paid,SHIPPED")).select(
        "batch", F.size("ids").cast("long").alias("id_count"), F.element_at("ids", 1).alias("first_id"),
        F.element_at("ids", -1).alias("last_id"))


CONFIGS = """
SELECT event_type AS slug, event_type <> 'error' AS active,
  CASE event_type WHEN 'click' THEN '10.0.0.1, 10.0.0.2' WHEN 'view' THEN '*' ELSE '' END AS ip_allowlist,
  CASE WHEN event_type = 'view' THEN 'X-Key' END AS secret_name, 'k1 ' AS secret_value, event_type <> 'purchase' AS schema_ok
FROM {events} WHERE event_type <> 'signup' GROUP BY event_type
"""


@query("ingest_status_events", """
SELECT event_id, CASE event_type WHEN 'signup' THEN 'NOT_FOUND' WHEN 'error' THEN 'INACTIVE'
  WHEN 'click' THEN CASE WHEN user_id % 5 IN (1, 2) THEN CASE WHEN event_id % 10 = 0 THEN 'FAILED' ELSE 'SUCCESS' END ELSE 'UNAUTHORIZED' END
  WHEN 'view' THEN CASE WHEN event_id % 3 = 0 THEN CASE WHEN event_id % 10 = 0 THEN 'FAILED' ELSE 'SUCCESS' END ELSE 'UNAUTHORIZED' END
  WHEN 'purchase' THEN 'INVALID_SCHEMA' END AS status FROM {events}""")
def ingest_status_events(t: Tables):
    events = t.sql("""SELECT event_id, event_type AS slug, '10.0.0.' || CAST(user_id % 5 AS STRING) AS client_ip,
      CASE event_id % 3 WHEN 0 THEN '{"x-key": " k1"}' WHEN 1 THEN '{"X-Key": "no"}' ELSE '{}' END AS headers_json,
      event_id % 10 <> 0 AS insert_ok FROM {events}""")
    return jsonland.classify_events(events, t.sql(CONFIGS)).select("event_id", "status")


@query("ingest_status_counts", """
SELECT event_type AS slug, event_type = 'signup' AS unknown, count(*) AS row_count FROM {events} GROUP BY 1, 2""")
def ingest_status_counts(t: Tables):
    events = t.sql("SELECT event_type AS slug, '10.0.0.1' AS client_ip, '{}' AS headers_json FROM {events}")
    done = jsonland.classify_events(events, t.sql(CONFIGS)).withColumn("unknown", F.col("status") == "NOT_FOUND")
    return diff.status_counts(done, ["slug", "unknown"])
