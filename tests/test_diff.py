import itertools
import random

import pytest
from pyspark.sql import functions as F

from evenkeel.operators import diff as d
from evenkeel.operators import versioned
from evenkeel.sources import snapshots


def brute(source, target):
    """Source rows by key (last wins), target rows each on their own."""
    by_key = {}
    for row in sorted(source, key=lambda r: (r[1] is not None, r[1] or "")):
        by_key[row[0]] = row
    out, seen = [], set()
    for key, value in target:
        if key in by_key:
            seen.add(key)
            same = (by_key[key][1] or "").strip().lower() == (value or "").strip().lower() \
                and (by_key[key][1] is None) == (value is None)
            out.append((key, "MATCH" if same else "DIFFERENT"))
        else:
            out.append((key, "TARGET_ONLY"))
    out += [(key, "SOURCE_ONLY") for key in by_key if key not in seen]
    return sorted(out, key=repr)


def random_rows(rng, n, keys):
    return [(rng.choice(keys), rng.choice(["a", "A ", "b", "", None])) for _ in range(n)]


@pytest.mark.parametrize("hot", [{}, {"share": 0.02, "min_rows": 2}])
def test_repeated_and_null_keys_against_brute_force(spark, hot):
    rng = random.Random(5)
    keys = [None, 0, 1, 2, 3, 4, 5, 6, 7]
    source = random_rows(rng, 40, keys)
    target = random_rows(rng, 60, keys[:7]) + [(3, "a")] * 40
    s, t = (spark.createDataFrame(rows, "k long, v string") for rows in (source, target))
    got = d.row_diff(s, t, d.DiffSpec(keys=["K"], hot_key_args=hot))
    key = F.coalesce("s_k", "t_k").alias("k")
    assert sorted([tuple(r) for r in got.select(key, "status").collect()], key=repr) == brute(source, target)


def test_hot_keys_change_no_result(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(200), str(rng.randrange(5))) for _ in range(2000)] + [(7, "x")] * 1500 + [(None, "n")] * 900
    source = spark.createDataFrame([(i, str(i % 5)) for i in range(0, 250, 2)] + [(None, "n")], "k long, v string")
    target = spark.createDataFrame(rows, "k long, v string")
    plain, hot = (
        sorted(d.row_diff(source, target, d.DiffSpec(keys=["k"], hot_key_args=args)).collect(), key=repr)
        for args in ({"min_rows": 10 ** 9}, {"share": 0.1, "min_rows": 100}))
    assert plain == hot and len(plain) > 4400


def test_hot_key_plan_broadcasts_the_hot_part(spark):
    target = spark.range(20000).select((F.col("id") % 3 * F.col("id")).alias("k"), F.lit(1).alias("v"))
    got = d.row_diff(spark.range(100).select(F.col("id").alias("k"), F.lit(1).alias("v")), target,
                     d.DiffSpec(keys=["k"], hot_key_args={"share": 0.1, "min_rows": 100}))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "FullOuter" in plan


def test_unique_keys_make_one_full_outer_join(spark):
    a = spark.range(10).select("id", F.lit("x").alias("v"))
    spec = d.DiffSpec(keys=["id"], unique_keys=True)
    plan = d.row_diff(a, a, spec)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FullOuter") == 1 and "Aggregate" not in plan


def test_missing_target_column_reads_as_null(spark):
    s = spark.createDataFrame([(1, "a", "b"), (2, None, "c")], "k int, gone string, v string")
    t = spark.createDataFrame([(1, "b", 9), (2, "c", 9)], "K int, V string, more int")
    got = d.row_diff(s, t, d.DiffSpec(keys=["k"]))
    assert {(r["s_k"], r["status"]) for r in got.collect()} == {(1, "DIFFERENT"), (2, "MATCH")}
    assert "t_more" not in got.columns


def test_text_and_number_keys_meet_on_text(spark):
    s = spark.createDataFrame([(1,), (2,)], "k int")
    t = spark.createDataFrame([("1",), ("2.0",)], "k string")
    assert {(r["row_key"], r["status"]) for r in d.row_diff(s, t, d.DiffSpec(keys=["k"])).collect()} == {
        ("1", "MATCH"), ("2", "SOURCE_ONLY"), ("2.0", "TARGET_ONLY")}


def test_null_key_and_empty_key_differ(spark):
    s = spark.createDataFrame([(None, 1), ("", 2)], "k string, v int")
    t = spark.createDataFrame([(None, 1), ("x", 2)], "k string, v int")
    got = {(r["s_k"], r["t_k"], r["status"]) for r in d.row_diff(s, t, d.DiffSpec(keys=["k"])).collect()}
    assert got == {(None, None, "MATCH"), ("", None, "SOURCE_ONLY"), (None, "x", "TARGET_ONLY")}


def test_many_key_columns_keep_nulls_apart(spark):
    columns = ", ".join(f"c{i} int" for i in range(40))
    s = spark.createDataFrame([[None] + [0] * 39, [0] * 40], columns)
    t = spark.createDataFrame([[0] * 31 + [None] + [0] * 8, [0] * 40], columns)
    got = sorted((r["status"], r["row_key"].count("NULL")) for r in d.row_diff(s, t, d.DiffSpec()).collect())
    assert got == [("MATCH", 0), ("SOURCE_ONLY", 1), ("TARGET_ONLY", 1)]


def test_unique_keys_need_no_duplicate_handling(spark):
    a = spark.range(5).select("id", F.lit("x").alias("v"))
    plan = d.row_diff(a, a, d.DiffSpec(keys=["id"], unique_keys=True))._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan


def test_one_sided_cells_are_all_different(spark):
    s = spark.createDataFrame([(1, None)], "k int, v string")
    t = spark.createDataFrame([(2, None)], "k int, v string")
    cells = d.cell_diff(d.row_diff(s, t, d.DiffSpec(keys=["k"]))).collect()
    assert len(cells) == 4 and all(c["is_different"] for c in cells)


def test_sort_columns_pick_the_last_duplicate(spark):
    s = spark.createDataFrame([(1, 5, "old"), (1, 9, "new")], "k int, at int, v string")
    t = spark.createDataFrame([(1, 9, "NEW")], "k int, at int, v string")
    got = d.row_diff(s, t, d.DiffSpec(keys=["k"], sort=["at"])).collect()
    assert [r["status"] for r in got] == ["MATCH"]


def test_resolve_keys_order(spark):
    df = spark.createDataFrame([(1, 2, 3)], "A int, b int, __rn__ int")
    assert d.resolve_keys(d.DiffSpec(keys=["a"], declared_keys=["b"]), df) == ["A"]
    assert d.resolve_keys(d.DiffSpec(declared_keys=["B"], sort=["a"]), df) == ["b"]
    assert d.resolve_keys(d.DiffSpec(sort=["a"]), df) == ["A"]
    assert d.resolve_keys(d.DiffSpec(exclude=["b "]), df) == ["A"]
    with pytest.raises(ValueError):
        d.resolve_keys(d.DiffSpec(keys=["zz"]), df)


def test_sync_makes_everything_match(spark, tmp_path):
    rng = random.Random(7)
    source = spark.createDataFrame([(i, rng.choice("abc"), float(i)) for i in range(0, 60)], "k int, v string, x double")
    target = spark.createDataFrame([(i, rng.choice("abc"), float(i), i) for i in range(20, 80)], "k int, v string, x double, own int")
    path = str(tmp_path / "t")
    snapshots.write_snapshot(target, path)
    spec = d.DiffSpec(keys=["k"])
    plan = versioned.sync_plan(d.row_diff(source, snapshots.read_snapshot(spark, path), spec), ["k"])
    counts = versioned.apply_sync(spark, path, plan, ["k"])
    after = snapshots.read_snapshot(spark, path)
    assert counts["inserted"] == 20 and counts["deleted"] == 20
    assert {r["status"] for r in d.row_diff(source, after, spec).collect()} == {"MATCH"}
    assert {r["own"] for r in after.filter("k >= 20").collect()} == set(range(20, 60))  # other columns stay
    assert after.filter("k < 20 and own is not null").count() == 0


def test_checksums_find_changed_buckets(spark):
    a = spark.range(1000).select("id", (F.col("id") * 2).alias("v"))
    b = a.withColumn("v", F.when(F.col("id") == 77, -1).otherwise(F.col("v")))
    assert d.differing_buckets(a, a, ["id"]).count() == 0
    assert d.differing_buckets(a, b, ["id"]).count() == 1
    assert d.differing_buckets(a, a.filter("id <> 5"), ["id"]).count() == 1


def test_compare_many_reports_failures_and_keeps_history(spark, tmp_path):
    calls = itertools.count()

    def broken():
        next(calls)
        raise ConnectionError("gone")

    a = spark.createDataFrame([(1, "a\u0000b"), (2, "c")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (3, "c")], "k int, v string")
    out = d.compare_many(spark, {"ab": lambda: (a, b, d.DiffSpec(keys=["k"])), "broken": broken},
                         history_path=str(tmp_path), run_id="7")
    rows = {r["table_name"]: r for r in out.collect()}
    assert rows["ab"]["total_differences"] == 3 and rows["ab"]["match_count"] == 0
    assert "gone" in rows["broken"]["error_message"] and next(calls) == 2  # tried twice
    history = spark.read.parquet(f"{tmp_path}/rows")
    run = d.run_history(spark.read.parquet(f"{tmp_path}/runs"), "compare").first()
    assert (run["different_count"], run["source_only_count"], run["target_only_count"]) == (1, 1, 1)
    assert run["error_message"].startswith("broken: ConnectionError")
    assert d.run_rows(history, 7, "ab").count() == 3
    assert history.filter(F.col("data_json").contains("\u0000")).count() == 0


def test_status_filter_names(spark):
    df = spark.createDataFrame([("MATCH",), ("DIFFERENT",)], "status string")
    assert d.filter_status(df, "all").count() == 2 and d.filter_status(df, "Identical").count() == 1
    with pytest.raises(ValueError):
        d.filter_status(df, "other")


def test_mappings_find_their_template_by_id(spark):
    mappings = spark.createDataFrame([("template-7", "own"), ("tpl_x", "own"), ("hand", "own"), ("template-", "own")], "id string, query string")
    templates = spark.createDataFrame([("7", "seven"), ("tpl_x", " ")], "template_id string, query string")
    got = {r["id"]: r["query"] for r in d.resolve_mappings(mappings, templates).collect()}
    assert got == {"template-7": "seven", "tpl_x": "own", "hand": "own", "template-": "own"}


def test_numeric_mode_reaches_cells_and_reports(spark):
    make = lambda v: spark.sql(f"SELECT 1 AS k, CAST('{v}' AS DECIMAL(38,20)) AS v")
    a, b = make("1.00000000000000000001"), make("1.00000000000000000002")
    diff = d.row_diff(a, b, d.DiffSpec(keys=["k"], numeric="exact"))
    assert diff.first()["status"] == d.DIFFERENT
    assert {(r["column"], r["is_different"]) for r in d.cell_diff(diff).collect()} == {("k", False), ("v", True)}
    assert "[TGT]" in d.render_cells(diff).first()["v"]
    assert d.row_diff(a, b, d.DiffSpec(keys=["k"])).first()["status"] == d.MATCH


def test_declared_keys_that_repeat_keep_the_last_row(spark):
    source = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    target = spark.createDataFrame([(1, "b")], "k bigint, v string")
    got = d.row_diff(source, target, d.DiffSpec(declared_keys=["k"])).collect()
    assert [(r["row_key"], r["status"]) for r in got] == [("1", d.MATCH)]
