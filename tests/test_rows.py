import datetime

import pytest
from pyspark.sql import functions as F

from evenkeel.functions import json as js
from evenkeel.functions import values
from evenkeel.operators import contacts, filters, incremental, jsonland, matching, monitor, quality


def ids(df):
    return sorted(r[0] for r in df.select("id").collect())


# ---------------------------------------------------------------- filters

@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame([(1, "Ann", 10.0), (2, "bob", None), (3, None, 30.0), (4, "ANNA", 40.0)], "id int, name string, x double")


@pytest.mark.parametrize("items, want", [
    (None, [1, 2, 3, 4]), ([], [1, 2, 3, 4]), ([{"op": "="}], [1, 2, 3, 4]),
    ([{"field": "name", "op": "like", "value": "Ann%"}], [1]),
    ([{"field": "name", "op": "NOT ILIKE", "value": "ann%"}], [2]),
    ([{"field": "id", "op": "in", "value": "1, 4"}], [1, 4]),
    ([{"field": "id", "op": "IN", "value": []}], []), ([{"field": "id", "op": "NOT IN", "value": None}], [1, 2, 3, 4]),
    ([{"field": "x", "op": ">=", "value": "30"}], [3, 4]), ([{"field": "x", "op": "IS NULL"}], [2]),
    ([{"field": "id", "op": "<>", "value": 1}, {"field": "name", "op": "IS NOT NULL"}], [2, 4]),
])
def test_structured_filter(people, items, want):
    assert ids(filters.structured_filter(people, items)) == want


@pytest.mark.parametrize("item", [{"field": "x; drop", "op": "="}, {"field": "x", "op": "SOUNDS"}])
def test_structured_filter_refuses(people, item):
    with pytest.raises(ValueError):
        filters.structured_filter(people, [item])


def test_filters_reach_the_scan(spark):
    df = filters.structured_filter(spark.read.parquet("/root/testdata/sf0.001/orders.parquet"),
                                   [{"field": "o_orderkey", "op": ">=", "value": 10}]).select("o_orderkey")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderkey), GreaterThanOrEqual(o_orderkey,10)]" in plan
    assert "ReadSchema: struct<o_orderkey:bigint>" in plan


def test_range_query_ignores_unsafe_parts(people):
    assert ids(filters.range_query(people, "id; --", "2024-01-01", None)) == [1, 2, 3, 4]
    assert ids(filters.range_query(people, None, None, None, "id > 2", None)) == [3, 4]
    dated = people.withColumn("d", F.expr("date'2024-01-01' + id"))
    assert ids(filters.range_query(dated, "d", "2024-01-03", "no date")) == [2, 3, 4]


@pytest.mark.parametrize("rules, ip, want", [
    ("", "9.9.9.9", True), (None, None, True), ("*", "x", True), ("1.2.3.4;0.0.0.0/0", "9.9.9.9", True),
    ("10.0.0.0/8", "10.255.0.1", True), ("10.0.0.0/8", "11.0.0.1", False), ("10.0.0.7/31", "10.0.0.6", True),
    ("10.1.2.*", "10.1.2.200", True), ("10.1.2.*", "10.1.20.2", False), ("1.2.3.4", "::ffff:1.2.3.4", True),
    ("localhost", "::1", True), ("::1", "127.0.0.1", True), ("127.0.0.1", None, True), ("1.2.3.4", None, False),
    ("1.2.3.4/40", "1.2.3.4", False), ("10.0.0.0/8", "10.0.0.999", False), ("10.0.0.0/8", "host", False),
    ("1.1.1.1\n2.2.2.2", "2.2.2.2", True), ("0.0.0.1/0", "200.1.1.1", True),
])
def test_ip_rules(spark, rules, ip, want):
    df = spark.createDataFrame([(1, ip)], "id int, client_ip string")
    assert (filters.ip_allowlist(df, rules).count() == 1) is want


def test_search_blank_keeps_all(people):
    assert ids(filters.search_any(people, "  ")) == [1, 2, 3, 4]
    assert ids(filters.search_any(people, "NN")) == [1, 4]


# ---------------------------------------------------------------- quality

def errors_of(spark, rule, value):
    df = spark.createDataFrame([(value,)], "v string")
    row = quality.validate_rows(df, [rule]).first()
    return row["v"], row["errors"]


R = quality.RowRule


@pytest.mark.parametrize("rule, value, out, count", [
    (R("v", required=True), "  ", None, 1), (R("v", default="d"), None, "d", 0), (R("v"), " ", None, 0),
    (R("v", "integer"), " 42 ", 42, 0), (R("v", "integer"), "3.7", None, 1), (R("v", "integer"), "99999999999", None, 1),
    (R("v", "integer", min=5, max=9), "4", 4, 1), (R("v", "number", max=1.5), "1.6", 1.6, 1),
    (R("v", "boolean"), "TRUE", True, 0), (R("v", "boolean"), "0", False, 0), (R("v", "boolean"), "yes", None, 1),
    (R("v", "date"), "2024-02-29", datetime.date(2024, 2, 29), 0), (R("v", "date"), "2024-2-9", None, 1),
    (R("v", pattern="a|b"), "ab", "ab", 1), (R("v", pattern="a|b"), "b", "b", 0),
    (R("v", "integer", pattern="x", allowed=["y"]), "z", None, 1),     # a type failure skips the rest
    (R("v", allowed=["Yes ", "no"]), " YES", " YES", 0), (R("v", transform="trim,upper", min_length=3), " ab ", "AB", 1),
    (R("v", max_length=2, message="too long"), "abc", "abc", 1),
])
def test_row_rules(spark, rule, value, out, count):
    got, errors = errors_of(spark, rule, value)
    assert got == out and len(errors) == count
    assert not rule.message or errors == [rule.message]


def test_first_failure_stops(spark):
    rules = [{"name": "a", "sql": "SELECT 0", "expect": "EQ_0"}, {"name": "b", "sql": "SELECT 2", "expect": "EQ_1", "message": "m"},
             {"name": "c", "sql": "SELECT * FROM absent", "expect": "EQ_1"}]
    assert quality.first_failure(spark, rules) == "m"
    assert quality.first_failure(spark, rules[:1]) is None


def test_usage_falls_back_per_host(spark):
    disks = spark.createDataFrame([("h1", "sda", "/", 95.0, 1), ("h1", "sdb", "/data", 99.0, 2), ("h2", "sdc", "/", 97.0, 3)],
                                  "host string, filesystem string, mount string, usage_percent double, id int")
    got = quality.threshold_alerts(disks, [{"rule": "r", "target": "DATA", "limit": 90}])
    assert ids(got) == [2, 3]
    root = quality.threshold_alerts(disks, [{"rule": "r", "target": "vda", "limit": 90}])
    assert ids(root) == [1, 3]
    assert ids(quality.memory_alerts(disks, 97, "usage_percent")) == [2, 3]


def test_bytes(spark):
    df = spark.createDataFrame([(0,), (1023,), (1024,), (1536,), (1048576,), (5 * 1024 ** 3,), (None,)], "b long")
    assert [r[0] for r in df.select(values.format_bytes(F.col("b"))).collect()] == [
        "0 B", "1023 B", "1.0 KiB", "1.5 KiB", "1.00 MiB", "5.00 GiB", None]


# ---------------------------------------------------------------- new rows

def test_high_water_loses_no_tied_rows(spark):
    df = spark.createDataFrame([(i, i // 7) for i in range(50)], "id int, v int")
    first, last = incremental.high_water_read(df, "v", None, ["id"])
    assert first.count() == 0 and tuple(last.first()) == (7, 49)
    seen, mark = [], (-1, -1)
    while True:
        rows, last = incremental.high_water_read(df, "v", mark, ["id"], cap=9)
        got = [r["id"] for r in rows.collect()]
        if not got:
            break
        seen += got
        mark = tuple(last.first())
    assert seen == list(range(50))
    with pytest.raises(ValueError):
        incremental.high_water_read(df, "v", 3, ["id"])
    for cap in (None, 1, 9, 10):  # without keys a read ends only at the end of a run
        seen, mark = [], -1
        while True:
            rows, last = incremental.high_water_read(df, "v", mark, cap=cap)
            got = [r["id"] for r in rows.collect()]
            if not got:
                break
            seen += got
            mark = last.first()["mark"]
        assert sorted(seen) == list(range(50))
    assert incremental.parse_mark(" 12 ") == 12 and incremental.parse_mark("") == 0 and incremental.parse_mark("x") == "x"


def test_retries_end_in_dead_letters(spark):
    tasks = spark.createDataFrame([(1, 0), (2, 2), (3, 3)], "id int, round int").withColumn(
        "retry_at", F.lit("2024-01-01 00:01:00").cast("timestamp_ntz"))
    now = F.lit("2024-01-01 00:01:00").cast("timestamp_ntz")
    assert ids(incremental.retry_due(tasks, now)) == [1, 2] and ids(incremental.retries_spent(tasks)) == [3]
    again = incremental.schedule_retry(tasks, now)
    assert ids(incremental.retry_due(again, now)) == []


# ---------------------------------------------------------------- json

@pytest.mark.parametrize("payload, want", [
    (None, "[{}]"), ("  ", "[{}]"), ('{"a": 1}', '[{"a": 1}]'), ("[1,  2]", "[1,  2]"), ("5", "[5]"), ("true", "[true]"),
    ('"plain"', '["plain"]'), ('"{\\"a\\": 1}"', '[{"a": 1}]'), ('he said "x"', '["he said \\"x\\""]'), ("null", "[null]"),
])
def test_bundle(spark, payload, want):
    df = spark.createDataFrame([(payload,)], "p string")
    assert df.select(js.bundle_payload(F.col("p"))).first()[0] == want


def test_bundle_without_blank_gives_no_row(spark):
    df = spark.createDataFrame([(None,), (" ",), ("{}",)], "payload string")
    assert jsonland.land_json(df).count() == 1
    assert jsonland.land_json(df, blank="{}").count() == 3


def test_flatten_reads_odd_values(spark):
    docs = spark.createDataFrame([("c", '[{"data": [{"n": -5, "f": "x", "b": 1, "s": {"k": [1]}}, {"n": 3.7}]}]'),
                                  ("c", '{"data": [1]}'), ("c", "bad"), ("d", '[{"data": [{"n": 1}]}]')], "kode_data string, detail_data string")
    fields = [{"name": "n", "type": "Int64"}, {"name": "f", "type": "Float64"}, {"name": "b", "type": "Bool"}, {"name": "s"}]
    got = [tuple(r) for r in jsonland.flatten_items(docs, "c", fields).drop("sync_dt", "kode_data").collect()]
    assert sorted(got) == [(-5, 0.0, True, '{"k":[1]}'), (0, 0.0, False, "")]


def test_every_element_and_item_counts(spark):
    docs = spark.createDataFrame([("c", '[{"data": [{"a": 1}, {"a": 2, "b": "x"}]}, {"data": [{"a": 3}]}]'), ("c", '[{"z": true}, {"y": 1}]'),
                                  ("c", '{"data": [{"w": 1.5}]}')], "kode_data string, detail_data string")
    rows = jsonland.flatten_items(docs, "c", [{"name": "a", "type": "Int64"}]).collect()
    assert sorted(r["a"] for r in rows) == [1, 2, 3]
    found = {r["name"]: r["type"] for r in jsonland.infer_json_schema(docs).collect()}
    assert found == {"a": "Int64", "b": "String", "z": "Bool", "y": "Int64", "w": "Float64"}


def test_numbers_of_batches_never_meet(spark):
    df = spark.range(3000).select(F.to_json(F.struct("id")).alias("payload"))
    first = jsonland.land_json(df, batch_millis=5)
    second = jsonland.land_json(df, batch_millis=6, above=jsonland.highest_seq(first))
    assert first.union(second).select("seq").distinct().count() == 6000
    assert first.agg(F.min("seq"), F.max("seq")).first()[:] == (5000, 7999) and second.agg(F.min("seq")).first()[0] == 8000


def test_range_takes_whole_dates(spark):
    from evenkeel.operators.filters import range_query

    df = spark.sql("SELECT timestamp_ntz'1997-12-31 10:00:00' AS at, date'1997-12-31' AS day")
    assert range_query(df, "at", "1997-01-01x", "1997-12-31").count() == 1
    assert range_query(df, "at", None, "1997-12-30").count() == 0
    assert range_query(df, "at", "1997-12-31T10:00:00", "1997-12-31 10:00:00").count() == 1
    assert range_query(df, "day", "1997-12-31", "1997-12-31").count() == 1


def test_infer_schema_forms(spark):
    docs = spark.createDataFrame([('[{"data": [{"a": 1, "n": null}]}]',), ('[{"a": 2.5, "b": true}]',),
                                  ('{"data": [{"c": "x"}]}',), ('{"d": [1]}',), ("bad",)], "detail_data string")
    got = {r["name"]: r["type"] for r in jsonland.infer_json_schema(docs).collect()}
    assert got == {"a": "Float64", "n": "String", "b": "Bool", "c": "String", "d": "String"}


def test_id_batches_are_full(spark):
    ids_ = spark.range(120).select(F.format_string("%05d", "id").alias("order_id"))
    got = jsonland.id_batches(ids_).collect()
    assert sorted(len(r["ids"]) for r in got) == [20, 50, 50]


def test_rule_without_value_takes_missing(spark):
    df = spark.createDataFrame([(1, '{"a": "x"}'), (2, '{"b": "y"}')], "id int, payload string")
    assert ids(jsonland.match_events(df, [{"key": "a", "value": "*"}])) == [1, 2]
    assert ids(jsonland.match_events(df, [{"key": "a", "value": "X , z"}])) == [1]
    assert ids(jsonland.match_events(df, [])) == [1, 2]


# ---------------------------------------------------------------- matching, contacts, monitoring

def test_match_leaves_out_zero_scores(spark):
    records = spark.createDataFrame([(1, "abc", "zzz"), (2, "xyz", "qqq")], "id int, name string, city string")
    got = matching.match_records(records, [{"probe_id": 9, "name": "abc", "city": "abc"}], ["id", "name", "city"], 1)
    assert [(r["id"], r["probe_id"], r["score"]) for r in got.collect()] == [(1, "9", 100.0)]


def test_blocked_matches_are_some_of_all(spark):
    rows = [(i, f"name{i % 17}{'x' * (i % 3)}", f"city{i % 5}", i % 4) for i in range(60)]
    records = spark.createDataFrame(rows, "id int, name string, city string, area int")
    probes = records.withColumnRenamed("id", "probe_id")
    with pytest.raises(ValueError):
        matching.match_records(records, probes, ["name"])
    key = lambda df: {(r["id"], r["probe_id"], round(r["score"], 9)) for r in df.collect()}
    every = key(matching.match_records(records, [r.asDict() for r in probes.collect()], ["name", "city"], 60))
    blocked = key(matching.match_records(records, probes, ["name", "city"], 60, block_on=["area"]))
    assert blocked == {(i, p, s) for i, p, s in every if i % 4 == int(p) % 4} and blocked < every
    ranked = [(r["probe_id"], -r["score"]) for r in matching.best_first(matching.match_records(records, probes, ["name"], 60, block_on=["area"])).collect()]
    assert ranked == sorted(ranked)


def test_first_contact_in_list_order_counts(spark):
    people = spark.createDataFrame([
        (2, "b", "100", "0811", "Second", None, None), (1, "b", "200", "+62811", None, None, "first"), (0, "other", "100", "0811", "No", None, None)],
        "contact_id int, bot_id string, chat_id string, phone_number string, first_name string, last_name string, username string")
    rows = spark.createDataFrame([(1, "0811"), (2, "100;  62811,unknown"), (3, None), (4, " ")], "id int, who string")
    got = {(r["id"], r["token"]): (r["chat_id"], r["recipient_name"], r["recipient_phone"])
           for r in contacts.resolve_recipients(rows, people, "who", "b").collect()}
    assert got == {(1, "0811"): ("200", "@first", "+62811"), (2, "100"): ("100", "Second", "0811"),
                   (2, "62811"): ("200", "@first", "+62811"), (2, "unknown"): ("unknown", "unknown", "unknown")}


def test_progress_with_unknown_source(spark):
    some, none = spark.range(3), spark.range(0)
    row = lambda s, t: tuple(monitor.snapshot_progress(s, t).select("percent", "complete").first())
    assert row(-1, some) == (0.0, True) and row(-1, none) == (0.0, False)
    assert row(none, none) == (0.0, True) and row(spark.range(7), some) == (42.86, False)
    assert row(spark.range(2), some) == (100.0, True)


def test_classify_without_header_or_rules(spark):
    events = spark.createDataFrame([(1, "s", "1.1.1.1", None), (2, "x", "1.1.1.1", "{}")], "id int, slug string, client_ip string, headers_json string")
    configs = spark.createDataFrame([("s", True, None, " ", None)], "slug string, active boolean, ip_allowlist string, secret_name string, secret_value string")
    assert {(r["id"], r["status"]) for r in jsonland.classify_events(events, configs).collect()} == {(1, "SUCCESS"), (2, "NOT_FOUND")}
