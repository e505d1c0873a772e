import random

import pytest
from pyspark.sql import functions as F

from evenkeel.operators import diff as d
from evenkeel.operators.tree_diff import STRETCHES, _stretches, tree_diff

SPEC = d.DiffSpec(keys=["id"], unique_keys=True)


def both_ways(source, target, spec=SPEC):
    """Rows by the tree and by the plain comparison, and the tree's levels."""
    found = tree_diff(source, target, spec)
    plain = d.row_diff(source, target, d.replace(spec, return_matched=False))
    got, want = (sorted(map(tuple, df.collect()), key=repr) for df in (found.diff, plain))
    assert got == want
    return got, found.levels


def test_one_stretch_in_a_large_table(spark):
    """The second pass reads a small share of the rows, and the bounds of keys reach the scan."""
    source = spark.range(200_000).select((F.col("id") * 7 - 300_000).alias("id"), F.col("id").cast("string").alias("v"))
    target = source.filter("id not between 700 and 770").withColumn("v", F.when(F.col("id").between(0, 140), "other").otherwise(F.col("v")))
    got, levels = both_ways(source, target)
    assert {r[1] for r in got} == {"DIFFERENT", "SOURCE_ONLY"} and len(got) == 20 + 10
    assert levels[0].rows_read == 400_000 - 10 and len(levels) > 1
    assert sum(level.rows_read for level in levels[1:]) < 40_000 and levels[-1].rows_differing < 500


@pytest.mark.parametrize("kind", ["int", "string"])
def test_equals_row_diff_on_random_tables(spark, kind):
    rng = random.Random(4)
    for changed in (0, 3, 2000):
        rows = {rng.randrange(-10**6, 10**6): rng.choice(["a", "", None, "ü" * 50]) for _ in range(3000)}
        copy = dict(rows)
        for k in rng.sample(sorted(copy), changed):
            copy.pop(k) if rng.random() < 0.3 else copy.update({k: rng.choice(["changed", None, "A"])})
        copy |= {10**7 + i: "new" for i in range(changed)}
        source, target = ([(k, v) for k, v in t.items()] + [(None, None)] for t in (rows, copy))
        make = lambda t: spark.createDataFrame(t, "id int, v string").withColumn("id", F.col("id").cast(kind))
        got, levels = both_ways(make(source), make(target))
        assert bool(got) == bool(changed) and len(levels) >= 1


def test_nulls_types_and_empty_tables(spark):
    make = lambda rows, ddl="id long, v string, x int": spark.createDataFrame(rows, ddl)
    one = make([(1, "a", 1), (None, "n", 2), (2**63 - 1, "z", 3), (-2**63, None, 4)])
    assert both_ways(one, one)[0] == []
    assert len(both_ways(one, make([(1, "a", 1), (None, "m", 2)]))[0]) == 3  # null keys differ; places too far apart for ranges
    assert both_ways(one, make([(1, " A", 1), (None, "n", 2)]).drop("x"), SPEC)[0]  # a column that the target lacks
    assert both_ways(make([]), make([]))[0] == [] and len(both_ways(one, make([]))[0]) == len(both_ways(make([]), one)[0]) == 4
    short = make([(1, "a", 1), (5, "b", 2)], "ID int, V string, x long")  # names in other case, other widths
    assert both_ways(make([(1, "a", 1), (5, "c", 2)]), short)[0][0][1] == "DIFFERENT"
    assert both_ways(make([(1, "a", 1)]), make([("1", "b", 1)], "id string, v string, x int"))[0][0][1] == "DIFFERENT"
    # A repeated target key: its range holds another count.
    assert len(both_ways(one, one.union(make([(1, "b", 1)])))[0]) == 1
    with pytest.raises(ValueError, match="unique_keys"):
        tree_diff(one, one, d.DiffSpec(keys=["id"]))


def test_two_keys_and_hidden_columns(spark):
    rows = [(i // 10, i % 10, f"v{i}", i) for i in range(5000)]
    source = spark.createDataFrame(rows, "a int, b int, v string, seen int")
    target = source.withColumn("seen", F.col("seen") + 1).withColumn("v", F.when(F.expr("a = 77 and b = 3"), "x").otherwise(F.col("v")))
    got, _ = both_ways(source, target, d.DiffSpec(keys=["a", "b"], exclude=["SEEN"], unique_keys=True))
    assert len(got) == 1


def test_stretches_hold_all_ranges():
    rng = random.Random(1)
    for n in (1, 5, 31, 400):
        ranges = rng.sample(range(5000), n)
        held = _stretches(ranges)
        assert len(held) <= STRETCHES and all(any(a <= r <= b for a, b in held) for r in ranges)
    assert _stretches([4, 5, 6]) == [(4, 6)] and _stretches([1, 9]) == [(1, 1), (9, 9)]
