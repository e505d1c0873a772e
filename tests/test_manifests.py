"""Tables of buckets with manifests: equal to whole rewrites, and only touched buckets change."""

import os
import random

import pytest
from pyspark.sql import functions as F

from evenkeel.operators import versioned
from evenkeel.operators.diff import DiffSpec, row_diff
from evenkeel.sources import snapshots
from evenkeel.sources.manifests import BUCKET, BucketTable

ROWS = "k int, v string, version long, ingest_seq long, is_deleted boolean"


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns
            for d, _, found in os.walk(f"{path}/data") for f in found if f.endswith(".parquet")}


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, found in os.walk(path) for f in found if not f.endswith(".crc"))


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_upserts_equal_whole_rewrites_and_touch_few_buckets(spark, tmp_path):
    rng, path, whole = random.Random(4), str(tmp_path / "t"), str(tmp_path / "w")
    table, seq = BucketTable(spark, path, ["k"], buckets=16), 0
    for number in range(4):
        batch = []
        for _ in range(120 if number == 0 else 5):
            seq += 1
            batch.append((rng.choice([None, *range(40)]), f"v{seq}", rng.randrange(6), seq, rng.random() < 0.2))
        changes = spark.createDataFrame(batch + batch[:2], ROWS)
        before = files(path)
        table.upsert(changes, number)
        versioned.upsert(spark, whole, changes, ["k"])
        named = {(b, w) for b, writes in table.manifest()["folders"].items() for w in writes}
        if number:
            touched = {r[0] for r in changes.select(table.bucket()).distinct().collect()}
            assert {b for b, w in named if w == number + 1} == touched and len(touched) <= 6
        after = files(path)
        assert all(after[f] == at for f, at in before.items())  # nothing written is changed
        assert rows_of(table.read()) == rows_of(snapshots.read_snapshot(spark, whole))
        assert table.upsert(changes, number) == number + 1 and files(path) == after  # repeated
    assert rows_of(table.current()) == rows_of(versioned.read_upserted(spark, whole))
    assert rows_of(BucketTable(spark, path, ["k"], buckets=99).read(1)) != rows_of(table.read()) and table.buckets == 16


def test_expire_frees_what_it_says(spark, tmp_path):
    path = str(tmp_path / "t")
    table = BucketTable(spark, path, ["k"], buckets=8)
    make = lambda ks, v: spark.createDataFrame([(k, "x", v, k, False) for k in ks], ROWS)
    table.append(make(range(50), 1))
    table.append(make(range(3), 2))
    table.append(make(range(0), 3))
    assert table.read().count() == 53 and table.current().count() == 50
    assert 1 <= table.compact() <= 3 and table.compact() == 0
    assert table.read().count() == 50 and table.read(1).count() == 50 and table.read(3).count() == 53
    want, kept = rows_of(table.read()), set(files(path))
    before = size(path)
    freed = table.expire(keep=1)
    assert freed > 0 and size(path) == before - freed and table.expire() == 0
    assert rows_of(table.read()) == want and set(files(path)) < kept
    with pytest.raises(FileNotFoundError):
        table.read(1)
    with pytest.raises(ValueError):
        table.expire(0)


def test_plans_by_buckets(spark, tmp_path):
    path = str(tmp_path / "t")
    target = spark.createDataFrame([(i, f"v{i}", i) for i in range(60)], "k int, v string, own int")
    source = spark.createDataFrame([(i, "new" if i in (5, 6) else f"v{i}") for i in range(2, 62)], "k long, v string")
    table = BucketTable(spark, path, ["k"], buckets=32, version="own", sequence=None)
    table.upsert(target)
    plan = versioned.sync_plan(row_diff(source, target.drop("own"), DiffSpec(keys=["k"])), ["k"])
    old = dict(table.manifest()["folders"])
    assert table.apply(plan) == {"inserted": 2, "updated": 2, "deleted": 2}
    assert rows_of(table.read()) == rows_of(versioned.apply_plan(target, plan, ["k"]))
    new = table.manifest()["folders"]
    assert sum(new.get(b) != old.get(b) for b in range(32)) <= 6
    number = table.manifest()["number"]
    assert table.apply(plan.limit(0)) == {"inserted": 0, "updated": 0, "deleted": 0} and table.manifest()["number"] == number


def test_cases(spark, tmp_path):
    table = BucketTable(spark, str(tmp_path / "t"), ["k"], buckets=4)
    with pytest.raises(FileNotFoundError):
        table.read()
    empty = spark.createDataFrame([], ROWS)
    table.upsert(empty)
    assert rows_of(table.read()) == [] and table.compact() == 0
    table.upsert(spark.createDataFrame([(None, "a", 1, 1, False), (7, "b", 1, 1, False)], ROWS))
    wide = spark.createDataFrame([(7, "c", 2, 1, False, "more")], "k long, v string, version int, ingest_seq long, is_deleted boolean, extra string")
    table.upsert(wide)  # other types and one more column
    assert [(r["k"], r["v"], r["extra"]) for r in table.read().orderBy("k").collect()] == [(None, "a", None), (7, "c", "more")]
    with pytest.raises(ValueError):
        table.upsert(empty.withColumn(BUCKET, F.lit(1)))
    with pytest.raises(ValueError):
        BucketTable(spark, str(tmp_path / "t"), ["v"])


def test_a_stream_that_comes_again(spark, tmp_path):
    table = BucketTable(spark, str(tmp_path / "t"), ["k"], buckets=4)
    for i in range(2):
        spark.createDataFrame([(i, "a", 1, 1, False), (9, "b", i, i, False)], ROWS).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(ROWS).parquet(str(tmp_path / "in"))
        stream.writeStream.foreachBatch(table.sink()).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert rows_of(table.read().select("k", "version")) == [(0, 1), (1, 1), (9, 1)] and table.manifest()["batch"] == 1
