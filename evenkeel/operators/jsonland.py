"""Landing JSON payloads, flattening them, and reading events by path and rule."""

from __future__ import annotations

import re
import time
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from evenkeel.functions.events import node_values, order_rows
from evenkeel.functions.json import bundle_payload, json_path
from evenkeel.operators.ranking import rank_rows
from evenkeel.operators.skew import join_unique

LANDING_COLUMNS = ("seq", "kode_data", "detail_data", "input_by", "input_dt")

# Default codes of the two ways in, ids per request.
API_CODE, WEBHOOK_CODE = "API_DATA", "WEBHOOK"
ID_BATCH = 50

INPUT_BY = "evenkeel"


# ---------------------------------------------------------------- landing

def land_json(payloads: DataFrame, column: str = "payload", code: str = API_CODE, batch_millis: int | None = None,
              input_by: str = INPUT_BY, blank: str | None = None, above: int | None = None) -> DataFrame:
    """Payloads as landing rows ``seq, kode_data, detail_data, input_by, input_dt``.

    ``seq`` runs densely from the batch time in milliseconds times 1000, or from just over
    ``above`` if that is higher: pass the largest ``seq`` that the landing holds
    (``highest_seq``), and no number is ever given twice. Blank payloads give no row unless
    ``blank`` says what they read as.
    """
    base = batch_millis if batch_millis is not None else int(time.time() * 1000)
    start = max(base * 1000 - 1, above if above is not None else 0)
    bundled = bundle_payload(F.col(column), blank)
    rows = payloads.select(bundled.alias("detail_data")).filter(F.col("detail_data").isNotNull())
    return rank_rows(rows, (), ["detail_data"], "__n").select(
        (F.lit(start) + F.col("__n")).alias("seq"),
        F.lit(code).alias("kode_data"), "detail_data", F.lit(input_by).alias("input_by"),
        F.timestamp_millis(F.lit(base)).cast("timestamp_ntz").alias("input_dt"))


def highest_seq(landing: DataFrame) -> int | None:
    """The largest number given so far, for the next ``land_json``."""
    return landing.agg(F.max("seq")).first()[0]


def _typed(item: Column, key: str, kind: str) -> Column:
    text = F.try_variant_get(item, json_path(key), "string")
    kind = kind.lower()
    if kind in ("bool", "boolean"):
        return F.coalesce(text.try_cast("boolean"), F.lit(False))
    if kind in ("uint64", "int64", "bigint", "long"):
        return F.coalesce(text.try_cast("bigint"), F.lit(0).cast("bigint"))
    if kind in ("float64", "double"):
        return F.coalesce(text.try_cast("double"), F.lit(0.0))
    nested = F.to_json(F.try_variant_get(item, json_path(key), "variant"))
    return F.coalesce(text, nested, F.lit(""))


def flatten_items(landing: DataFrame, code: str, fields: Sequence[Mapping[str, str]],
                  stamp: Column | None = None) -> DataFrame:
    """Rows of one code: every item of each element's ``data`` list becomes a row.

    A field is ``{name, type, jsonKey}``. Numbers that do not parse read as zero,
    missing text as empty, a boolean that does not parse as false.
    """
    document = F.try_parse_json("detail_data")
    elements = F.explode(F.try_variant_get(document, "$", "array<variant>"))
    bundles = landing.filter(F.col("kode_data") == code).select("kode_data", elements.alias("element"))
    items = F.try_variant_get("element", "$.data", "array<variant>")
    rows = bundles.select("kode_data", F.explode(items).alias("item"))
    out = [_typed(F.col("item"), f.get("jsonKey") or f["name"], f.get("type", "String"))
           .alias(re.sub(r"[^a-zA-Z0-9_]", "_", f["name"])) for f in fields]
    return rows.select("kode_data", *out, (stamp if stamp is not None else F.now()).cast("string").alias("sync_dt"))


def infer_json_schema(landing: DataFrame, code: str | None = None) -> DataFrame:
    """Field names and types of all items, from all rows of a code.

    The items are those of the ``data`` list of each element, or of the object; without
    such a list the element, or the object, is the item. Mixed or nested fields read as String.
    """
    rows = landing.filter((F.col("kode_data") == code) if code else F.lit(True))
    document = F.try_parse_json("detail_data")
    listed = lambda v: F.coalesce(v, F.array())
    whole = F.coalesce(F.try_variant_get(document, "$", "array<variant>"), F.array(document))
    elements = rows.select(F.explode(listed(whole)).alias("element"))
    inner = F.try_variant_get("element", "$.data", "array<variant>")
    items = elements.select(F.explode(F.when(F.size(inner) > 0, inner).otherwise(F.array("element"))).alias("v"))
    item = F.try_variant_get("v", "$", "map<string,variant>")
    entry = F.explode(F.map_entries(item)).alias("e")
    kind = F.schema_of_variant("e.value")
    name = (F.when(kind == "BOOLEAN", "Bool").when(kind == "BIGINT", "Int64")
            .when(kind.startswith("DECIMAL") | (kind == "DOUBLE") | (kind == "FLOAT"), "Float64")
            .when(kind == "VOID", None).otherwise("String"))
    seen = items.select(entry).select(F.col("e.key").alias("name"), name.alias("type"))
    kinds = seen.groupBy("name").agg(F.collect_set("type").alias("t"))  # at most four types each
    both = (F.when(F.size("t") == 1, F.col("t")[0])
            .when(F.array_size(F.array_except("t", F.array(F.lit("Int64"), F.lit("Float64")))) == 0,
                  F.when(F.size("t") == 2, F.lit("Float64")).otherwise(F.lit("String")))
            .otherwise("String"))
    return kinds.select("name", both.alias("type"))


# ---------------------------------------------------------------- events: rules and parameters

def value_matches(value: Column, wanted: str | None) -> Column:
    """Whether a value is in a comma list, ignoring case; ``*`` or nothing takes any value,
    also a missing one."""
    if wanted is None or wanted.strip() in ("", "*"):
        return F.lit(True)
    choices = sorted({w.strip().lower() for w in wanted.split(",") if w.strip()})
    return F.coalesce(F.lower(F.trim(value)).isin(choices) & (F.trim(value) != ""), F.lit(False))


def _rule_test(rules: Sequence[Mapping[str, str]], values: Column, first: int = 0) -> Column:
    tests = [value_matches(values[first + i], r.get("value")) for i, r in enumerate(rules)]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def match_events(events: DataFrame, rules: Sequence[Mapping[str, str]], payload: str = "payload") -> DataFrame:
    """Objects of the events that meet all rules ``{key, value}``, as column ``node`` (JSON)."""
    nodes = node_values(events, payload, [r["key"] for r in rules])
    return nodes.filter(_rule_test(rules, F.col("values"))).drop("values")


def extract_params(events: DataFrame, rules: Sequence[Mapping[str, str]], mappings: Sequence[Mapping[str, str]],
                   by: Sequence[str] = (), payload: str = "payload") -> DataFrame:
    """Distinct parameter rows of the matching objects, one column per mapping ``{target, source}``.

    Empty values read as null and objects giving none are left out; without mappings a match
    gives one row of no parameters. ``pk`` and ``value`` repeat the first value, and ``orderId``
    the value of ``order_id`` or ``orderIds``, unless a mapping gives them.
    """
    paths = [*(r["key"] for r in rules), *(m["source"] for m in mappings)]
    nodes = node_values(events.select(*dict.fromkeys([*by, payload])), payload, paths).withColumn("__values", F.col("values"))
    found = nodes.filter(_rule_test(rules, F.col("__values")))
    params = {m["target"]: F.nullif(F.trim(F.col("__values")[len(rules) + i]), F.lit("")) for i, m in enumerate(mappings)}
    if not params:
        none = F.lit(None).cast("string")
        return found.select(*by, none.alias("pk"), none.alias("value")).dropDuplicates()
    found = found.select(*by, *[c.alias(n) for n, c in params.items()]).dropna("all", subset=list(params))
    order = next((n for n in ("order_id", "orderIds") if n in params), None)
    if order and "orderId" not in params:
        found = found.withColumn("orderId", F.col(order))
    first = F.coalesce(*[F.col(f"`{n}`") for n in params])
    return found.withColumns({n: first for n in ("pk", "value") if n not in params}).dropDuplicates()


def order_ids(events: DataFrame, status: str | None, payload: str = "payload") -> DataFrame:
    """Distinct ids of the orders whose status is wanted, wherever they sit in the events."""
    orders = order_rows(events, payload)
    return orders.filter(value_matches(F.col("status"), status)).select("order_id").distinct()


def id_batches(ids: DataFrame, column: str = "order_id", size: int = ID_BATCH) -> DataFrame:
    """The ids in batches of ``size``, as ``batch`` and an array ``ids``."""
    numbered = rank_rows(ids, (), [column], "__n")
    batch = F.floor((F.col("__n") - 1) / size).cast("long")
    return numbered.groupBy(batch.alias("batch")).agg(F.array_sort(F.collect_list(column)).alias("ids"))


# ---------------------------------------------------------------- event status

def _listed(ip: Column, rules: Column) -> Column:
    """Address test of event endpoints, with the rules in a column: exact, ``*`` or localhost."""
    entries = F.filter(F.transform(F.split(rules, ","), lambda r: F.lower(F.trim(r))), lambda r: r != "")
    local = F.array(F.lit("localhost"), F.lit("127.0.0.1"), F.lit("::1"))
    return (F.coalesce(F.trim(rules), F.lit("")) == "") | F.coalesce(
        F.arrays_overlap(entries, F.array(F.lit("*"), F.lit("0.0.0.0/0"), F.lower(ip)))
        | (ip.isin("127.0.0.1", "::1") & F.arrays_overlap(entries, local)), F.lit(False))


def classify_events(events: DataFrame, configs: DataFrame) -> DataFrame:
    """Status of each event against the config of its slug (one each); the first check that
    fails decides.

    NOT_FOUND, INACTIVE, UNAUTHORIZED (address, then secret header), INVALID_SCHEMA
    (landing table lacks columns: ``schema_ok`` false), FAILED (``insert_ok`` false on
    the event, if it has that column), else SUCCESS.
    """
    # One config a slug, also where a slug repeats: the least by its columns.
    own = configs.groupBy("slug").agg(F.min(F.struct(*[c for c in configs.columns if c != "slug"])).alias("__cfg"))
    joined = join_unique(events, own, ["slug"])
    header = F.try_variant_get(F.try_parse_json("headers_json"), "$", "map<string,string>")
    wanted = F.lower(F.trim("__cfg.secret_name"))
    sent = F.map_values(F.map_filter(header, lambda k, v: F.lower(k) == wanted))
    needs_secret = F.coalesce(wanted != "", F.lit(False))
    secret_ok = ~needs_secret | F.coalesce(
        F.trim(F.get(sent, F.lit(0))) == F.coalesce(F.trim("__cfg.secret_value"), F.lit("")), F.lit(False))
    inserted = F.coalesce(F.col("insert_ok"), F.lit(True)) if "insert_ok" in events.columns else F.lit(True)
    status = (
        F.when(F.col("__cfg").isNull(), "NOT_FOUND")
        .when(~F.coalesce("__cfg.active", F.lit(False)), "INACTIVE")
        .when(~_listed(F.col("client_ip"), F.col("__cfg.ip_allowlist")), "UNAUTHORIZED")
        .when(~secret_ok, "UNAUTHORIZED")
        .when(~F.coalesce("__cfg.schema_ok", F.lit(True)) if "schema_ok" in configs.columns else F.lit(False),
              "INVALID_SCHEMA")
        .when(~inserted, "FAILED").otherwise("SUCCESS"))
    return joined.select(*events.columns, status.alias("status"))
