import json

import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from evenkeel.functions import events, values
from evenkeel.functions.similarity import jaro_scores
from evenkeel.operators import incremental


def jaro(a, b, floor):
    """Jaro from its definition."""
    if not a or not b:
        return 0.0
    if a == b:
        return 100.0
    reach = max(len(a), len(b)) // 2 - 1
    used, pairs = set(), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if j not in used and b[j] == c:
                used.add(j)
                pairs.append(i)
                break
    if not pairs:
        return 0.0
    m = len(pairs)
    moved = sum(a[i] != b[j] for i, j in zip(pairs, sorted(used)))
    half = moved // 2 if floor else moved / 2
    return (m / len(a) + m / len(b) + (m - half) / m) / 3 * 100


words = st.lists(st.tuples(st.text("abcé 𝄞", max_size=9), st.text("abcé 𝄞", max_size=9)), min_size=1, max_size=20)


@settings(max_examples=150, deadline=None)
@given(words, st.booleans())
def test_jaro_against_definition(pairs, floor):
    left, right = (pd.Series([p[i] for p in pairs]) for i in (0, 1))
    got = jaro_scores(left, right, floor)
    assert got == pytest.approx([jaro(a, b, floor) for a, b in pairs], abs=1e-9)


def test_jaro_known_and_null():
    got = jaro_scores(pd.Series(["MARTHA", None, "DIXON", "a"]), pd.Series(["MARHTA", "x", "DICKSONX", "b"]))
    assert got == pytest.approx([94.4444444, 0, 76.6666667, 0], abs=1e-6)


def test_jaro_long_texts():
    text = "lorem ipsum dolor " * 200
    assert jaro_scores(pd.Series([text]), pd.Series([text[::-1]])) == pytest.approx([jaro(text, text[::-1], False)])


@settings(max_examples=100, deadline=None)
@given(st.text("ab \n", max_size=9000), st.integers(600, 4000))
def test_split_keeps_all_but_the_cuts(text, longest):
    parts = incremental._parts(text, longest)
    assert all(len(p) <= longest + 1 for p in parts)
    if len(text) <= longest:
        assert parts == [text]
    else:
        squeeze = str.maketrans("", "", " \n")
        assert "".join(parts).translate(squeeze) == text.translate(squeeze)


def test_split_prefers_line_end_then_space(spark):
    line = "x" * 600 + "\n" + "y" * 300 + " " + "z" * 400
    df = spark.createDataFrame([(1, line), (2, "short"), (3, None)], "id int, t string")
    got = {(r["id"], r["part"]): r["part_text"] for r in incremental.split_long_text(df, "t", 1000).collect()}
    assert got[(1, 1)] == "x" * 600 + "\n\n<i>[Bagian 1/2]</i>"
    assert got[(1, 2)].startswith("y" * 300 + " " + "z" * 400)
    assert got[(2, 1)] == "short" and got[(3, 1)] == ""


def test_split_takes_small_batches(spark):
    """A Python worker holds few long texts at once, however many rows there are."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    try:
        df = spark.range(0, 1000, 1, 1).selectExpr("id", "repeat('a b ', 50) AS t")
        assert incremental.split_long_text(df, "t", 100).where("part = 1").count() == 1000
        assert 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 256
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_template(spark):
    df = spark.createDataFrame([(1, None)], "Id int, name string")
    text = lambda t, **k: values.render_template(df, t, **k).first()["message"]
    assert text("{{ID}}-{{ name }}-{{nope}}-{{ }}") == "1---{{ }}"
    assert text("") == "" and text("plain $1 \\") == "plain $1 \\"
    assert text("{{id}}", direct="id") == "1"


def test_phone(spark):
    df = spark.createDataFrame([("0811-22",), ("+62 811",), (None,), ("abc",)], "p string")
    assert [r[0] for r in df.select(values.normalize_phone(F.col("p"))).collect()] == ["6281122", "62811", "", ""]


EVENT = {
    "a": {"b": [{"c": 5}, {"c": "six"}]}, "order_id": "o1", "Flag": True, "none": None,
    "payload": '{"inner": "deep", "data": "{\\"deeper\\": 1.50}"}', "list": ["p", "q"], "obj": {"x": 1},
}


def _values(spark, event, paths):
    df = spark.createDataFrame([(json.dumps(event),)], "payload string")
    return events.path_values(df, "payload", {f"p{i}": p for i, p in enumerate(paths)}).drop("payload").first()[:]


def test_values_by_name_and_path(spark):
    wanted = {"orderId": "o1", "ORDER_ID": "o1", "flag": "true", "a.b[1].c": "", "inner": "deep", "deeper": "1.5", "none": "",
              "missing": "", "list": "", "": ""}
    assert dict(zip(wanted, _values(spark, EVENT, list(wanted)))) == wanted


def test_steps_without_boxed_text(spark):
    wanted = {"a.b[1].c": "six", "a.b.c": "5", "a.b[9].c": "", "a.b.0.c": "5", "list.1": "q", "list": "p", "obj": '{"x":1}', "x": "", "obj.x": "1"}
    assert dict(zip(wanted, _values(spark, EVENT | {"payload": None}, list(wanted)))) == wanted


def test_values_in_text_in_text(spark):
    event = {"found": "here"}
    for i in range(5):
        event = {"payload" if i % 2 else "data": json.dumps(event)}
    assert _values(spark, event, ["found", "absent"]) == ("here", "")


def test_objects_at_any_depth(spark):
    deep = {"id": 0}
    for i in range(1, 12):
        deep = {"id": i, "data": [deep]} if i % 2 else {"id": i, "orders": [deep]}
    df = spark.createDataFrame([(json.dumps(deep),), ("not json",), (None,), ("[]",)], "payload string")
    found = events.node_values(df, "payload", ["id"]).collect()
    assert sorted(int(r["values"][0]) for r in found) == list(range(12))


def test_no_mappings_give_a_row_without_parameters(spark):
    from evenkeel.operators import jsonland

    df = spark.createDataFrame([('{"a": "x", "order_id": 7}',), ('{"a": "y"}',)], "payload string")
    rule = [{"key": "a", "value": "x"}]
    assert jsonland.extract_params(df, rule, []).collect()[0][:] == (None, None)
    (row,) = jsonland.extract_params(df, rule, [{"target": "order_id", "source": "orderId"}]).collect()
    assert row.asDict() == {"order_id": "7", "orderId": "7", "pk": "7", "value": "7"}
