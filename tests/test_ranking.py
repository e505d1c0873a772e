import random

import pytest
from pyspark.sql import functions as F

from evenkeel.operators import ranking
from evenkeel.operators.skew import hot_keys, lookup_join


def numbered(rows):
    out, count = {}, {}
    for group, order, ident in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2])):
        count[group] = count.get(group, 0) + 1
        out[ident] = count[group]
    return out


def test_rank_rows_with_hot_and_null_groups(spark):
    rng = random.Random(3)
    rows = [(rng.choice([1, 1, 1, 1, 2, None, None, 3 + rng.randrange(50)]), rng.choice([None, *range(20)]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g int, o int, id int").repartition(8)
    want = numbered(rows)
    for args in ({"min_rows": 10 ** 9}, {"share": 0.05, "min_rows": 50}):
        got = ranking.rank_rows(df, ["g"], ["o", "id"], "n", **args)
        assert {r["id"]: r["n"] for r in got.collect()} == want


def test_row_number_over_everything(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("x"))
    got = sorted((r["x"], r["__rn__"]) for r in ranking.with_row_number(df, ["x"]).collect())
    assert [n for _, n in got] == list(range(1, 5001))


def test_pages_are_disjoint_and_complete_over_ties(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("x"), F.col("id").alias("y"), F.lit(1).alias("page"))
    index = ranking.PageIndex(df, ["x"], 25)
    pages = [[(r["x"], r["y"]) for r in index.page(n).collect()] for n in range(1, 6)]
    want = sorted((i % 3, i) for i in range(100))
    assert [sorted(p) for p in pages] == [want[0:25], want[25:50], want[50:75], want[75:], []]
    assert [tuple(r) for r in index.info().collect()] == [(100, 4)]
    assert sorted(r["y"] for r in ranking.paged(df, ["x"], 0, 25).collect()) == [y for _, y in want[:25]]
    assert ranking.PageIndex(df.where("false"), ["x"], 5).page(1).count() == 0


def test_equal_rows_are_each_on_a_page(spark):
    df = spark.range(90).select(F.lit("a").alias("x"), F.create_map(F.lit("k"), F.lit(1)).alias("m"))
    index = ranking.PageIndex(df, ["x"], 40)
    assert [index.page(n).count() for n in (1, 2, 3)] == [40, 40, 10]


def test_hot_keys_are_few_and_right(spark):
    df = spark.range(10000).select(F.when(F.col("id") % 2 == 0, -1).otherwise(F.col("id")).alias("k"))
    assert [r["k"] for r in hot_keys(df, ["k"], share=0.1, min_rows=100).collect()] == [-1]
    assert hot_keys(df, ["k"], share=0.6, min_rows=100) is None
    assert hot_keys(spark.range(100), ["id"]) is None


def test_lookup_join_with_hot_and_null_keys(spark):
    rng = random.Random(4)
    left = spark.createDataFrame([(rng.choice([None, None, 1, 1, 2, 3, 4 + rng.randrange(30)]), i) for i in range(2000)], "k int, id int")
    right = spark.createDataFrame([(k, f"v{k}") for k in range(1, 30, 2)], "k int, v string")
    for how in ("left", "inner", "left_semi", "left_anti"):
        plain = sorted(left.join(right, "k", how).collect(), key=repr)
        assert sorted(lookup_join(left, right, ["k"], how, share=0.05, min_rows=50).collect(), key=repr) == plain
        assert sorted(lookup_join(left, right, ["k"], how).collect(), key=repr) == plain


def test_document_number_continues_only_in_its_period(spark):
    rows = spark.createDataFrame([("a", "2024-01-05", 1), ("a", "2024-01-09", 2), ("a", "2024-02-01", 3), ("z", "2024-01-01", 4)],
                                 "k string, d string, id int").withColumn("ts", F.col("d").cast("timestamp_ntz"))
    base = {"seq_key": "a", "prefix": "P", "suffix": "S", "date_format": "yyMM", "date_separator": "-", "pad_length": 3}

    def run(**more):
        got = ranking.document_numbers(rows, [base | more], "k", "ts", ["id"])
        return [r["formatted"] for r in got.orderBy("id").collect()]

    assert run(reset_type="MONTHLY", current_value=7, last_reset_date="2024-01-02") == [
        "P-2401-008-S", "P-2401-009-S", "P-2402-001-S", None]
    assert run(reset_type="NONE", current_value=998, last_reset_date=None) == [
        "P-2401-999-S", "P-2401-1000-S", "P-2402-1001-S", None]
    assert run(reset_type="DAILY", current_value=5, last_reset_date=None, prefix="", suffix="") == ["001", "001", "001", None]


def test_ranges_by_expression(spark):
    rng = random.Random(5)
    rows = [(rng.choice([None, "a", "b", "ü"]), rng.choice([None, *range(300)]), i % 700) for i in range(4000)]
    df = spark.createDataFrame(rows, "g string, o int, id int").repartition(7)
    for bounds in (1, 2, 50, None):
        got = ranking.bounded_ranges(df, ["g", "o", "id"], bounds).orderBy("g", "o", "id").collect()
        places = [r["__range"] for r in got]
        assert sorted(tuple(r)[:3] for r in got if r["g"] is not None and r["o"] is not None) == sorted(
            r for r in rows if r[0] is not None and r[1] is not None)
        assert places == sorted(places) and len(set(places)) <= (bounds or 4000) + 1
        assert [r["__range"] for r in ranking.bounded_ranges(df.repartition(3), ["g", "o", "id"], bounds)
                .orderBy("g", "o", "id").collect()] == places
    assert max(places.count(p) for p in set(places)) < 60  # bounds spread over the rows
    assert ranking.bounded_ranges(df.limit(0), ["g"]).count() == 0


def test_numbers_go_on_over_batches(spark, tmp_path):
    """Against a counter kept by hand: ties, repeated rows, nulls, unknown sequences, late rows, an empty batch, repeated batches."""
    rng = random.Random(11)
    base = {"prefix": "P", "suffix": "", "date_format": "yyMM", "date_separator": "-", "pad_length": 3}
    definitions = [base | {"seq_key": "month", "reset_type": "MONTHLY", "current_value": 7, "last_reset_date": "2024-01-02"},
                   base | {"seq_key": "never", "reset_type": "NEVER", "current_value": 100, "last_reset_date": None}]
    counters = ranking.DocumentCounters(spark, str(tmp_path / "counters"), definitions)
    assert counters.counters() is None
    ddl, by_hand, given = "k string, ts string, id int, note string", {}, {}
    batches = []
    for size in (400, 0, 900, 250):
        rows = [(rng.choice(["month", "month", "never", "other", None]), rng.choice(["2024-01-05", "2024-01-06", "2024-02-01", None]),
                 rng.randrange(60), rng.choice([None, "x"])) for _ in range(size)]
        batches.append(rows + rows[:30])

    def give(batch):
        df = spark.createDataFrame(batches[batch], ddl).withColumn("ts", F.col("ts").cast("timestamp")).repartition(5)
        got = counters.number(df, batch, "k", "ts", ["id"]).withColumn("ts", F.date_format("ts", "yyyy-MM-dd"))
        return sorted((tuple(r) for r in got.collect()), key=repr)

    low = lambda v: (v is not None, v if v is not None else "")
    for batch, rows in enumerate(batches):
        want = []
        for k, ts, ident, note in sorted(rows, key=lambda r: (low(r[1]), r[2], low(r[0]), low(r[3]))):
            number = text = None
            if k in ("month", "never"):
                period = (k, ts and ts[:7]) if k == "month" else k
                begin = {("month", "2024-01"): 7, "never": 100}.get(period, 0)
                number = by_hand[period] = by_hand.get(period, begin) + 1
                text = ts and f"P-{ts[2:4]}{ts[5:7]}-{number:03d}"
            want.append((k, ts, ident, note, number, text))
        given[batch] = give(batch)
        assert given[batch] == sorted(want, key=repr)
    assert [give(b) for b in (1, 3, 0, 2)] == [given[b] for b in (1, 3, 0, 2)]
    assert {(r["seq_key"], r["period"]): r["last"] for r in counters.counters().collect()} == {
        ("never", "1970-01-01") if p == "never" else (p[0], f"{p[1]}-01" if p[1] else "undated"): n for p, n in by_hand.items()}
    counters.expire(keep=1)
    assert give(3) == given[3]
    with pytest.raises(ValueError, match="has no counters"):
        give(2)
    with pytest.raises(ValueError, match="made here"):
        counters.number(spark.createDataFrame([("never", None, 1)], "k string, ts timestamp, number int"), 9, "k", "ts", [])
