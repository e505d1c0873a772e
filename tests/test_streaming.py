import json
import random

import pytest
from pyspark.sql import functions as F

from evenkeel.operators.versioned import current_view, latest_version
from evenkeel.streaming import changes, warehouse

ROW = "id long, v string"


def message(op, lsn, row, topic="srv.sales.items"):
    side = "before" if op == "d" else "after"
    return {"topic": topic, "partition": 0, "offset": lsn, "value": json.dumps({"op": op, side: row, "source": {"lsn": lsn}})}


def write(path, name, messages):
    path.mkdir(exist_ok=True)
    (path / name).write_text("\n".join(json.dumps(m) for m in messages))


def landed(spark, path):
    return changes.unwrap_changes(changes.read_landing(spark, path), ROW)


def test_landing_survives_restart_and_sets_bad_messages_aside(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")

    def run():
        stream = changes.read_changes(spark, str(source), maxFilesPerTrigger=1)
        changes.land_changes(stream, out, str(tmp_path / "cp")).awaitTermination()

    write(source, "1.json", [message("c", 1, {"id": 1, "v": "a"}), message("c", 2, {"id": 2, "v": "b"}),
                             {"topic": "srv.sales.items", "value": "{bad"}, {"topic": "srv.sales.items", "value": None}])
    run()
    run()  # nothing new
    write(source, "2.json", [message("d", 3, {"id": 1, "v": "a"}), message("u", 4, {"id": 2, "v": "b2"}),
                             message("c", 5, {"id": 9, "v": "x"}, "srv.public._dbz_heartbeat")])
    run()
    assert landed(spark, out).count() == 4
    now = {(r["id"], r["v"]) for r in current_view(landed(spark, out), ["id"]).collect()}
    assert now == {(2, "b2")}
    dead = changes.read_dead(spark, out)
    assert [r["value"] for r in dead.collect()] == ["{bad"] and dead.first()["failed_at"] is not None
    assert changes.unwrap_changes(changes.read_landing(spark, out, "cdc_db_sales_items"), ROW).count() == 4
    assert changes.read_landing(spark, out, "cdc_db_sales_others").count() == 0


def test_each_message_lands_once(spark, tmp_path):
    """Overlapping reads, in any order, also under a new checkpoint and after a restart."""
    out, offsets = str(tmp_path / "out"), str(tmp_path / "offsets")
    batch = [message("c", i, {"id": i, "v": "a"}) for i in range(12)]

    def run(source, checkpoint):
        stream = changes.read_changes(spark, str(tmp_path / source), maxFilesPerTrigger=1)
        changes.land_changes(stream, out, str(tmp_path / checkpoint), offsets=offsets).awaitTermination()

    def landed_ids():
        return sorted(r["id"] for r in landed(spark, out).select("id").collect())

    write(tmp_path / "one", "1.json", [*batch[4:8], batch[5]])
    run("one", "cp1")
    assert landed_ids() == [4, 5, 6, 7]
    write(tmp_path / "one", "2.json", [*batch[6:10], *batch[:2]])  # earlier offsets come late
    run("one", "cp1")
    assert landed_ids() == [0, 1, 4, 5, 6, 7, 8, 9]
    run("one", "cp2")  # everything again
    assert landed_ids() == [0, 1, 4, 5, 6, 7, 8, 9]
    assert changes.compact_offsets(spark, offsets) > 1
    runs = sorted((r["lo"], r["hi"]) for r in changes._seen(spark, offsets).collect())
    assert runs == [(0, 1), (4, 9)] and changes.compact_offsets(spark, offsets) == 0
    write(tmp_path / "two", "3.json", [*batch, message("c", 3, {"id": 30, "v": "b"}, "srv.sales.others"), {"topic": "srv.sales.items", "value": "{}"}])
    run("two", "cp3")
    assert landed_ids() == [*range(12), 30]
    assert changes.read_landing(spark, out).where("offset is null").count() == 1  # without an offset


def test_runs_of_offsets(spark, monkeypatch):
    monkeypatch.setattr(changes, "RUN", 4)
    df = spark.createDataFrame([("t", i % 2, i // 2) for i in (0, 2, 4, 6, 8, 12, 14, 1, 1, 41)] + [("t", 0, None)], "topic string, partition int, offset long")
    runs = sorted((r["partition"], r["lo"], r["hi"]) for r in changes.offset_runs(df).collect())
    assert runs == [(0, 0, 3), (0, 4, 4), (0, 6, 7), (1, 0, 0), (1, 20, 20)]
    left = changes.unseen(df, changes.offset_runs(df.where("offset < 6")))
    assert sorted((r["partition"], r["offset"] or -1) for r in left.collect()) == [(0, -1), (0, 6), (0, 7), (1, 20)]


def test_offsets_with_gaps_are_no_pairs(spark, monkeypatch, capsys):
    """Known offsets are found without a join on ranges, also in runs over many stretches and under null topics."""
    monkeypatch.setattr(changes, "RUN", 8)
    rows = [("t" if i % 5 else None, i % 2, i * 3, f"v{i}") for i in range(200)]
    df = spark.createDataFrame(rows + rows[:20] + [("t", 0, None, "a"), ("t", 0, None, "a")], "topic string, partition int, offset long, value string")
    seen = changes.offset_runs(df.where("offset % 2 = 0")).union(spark.createDataFrame([("t", 1, 301, 399)], "topic string, partition int, lo long, hi long"))
    left = changes.unseen(df, seen)
    want = [r for r in rows if r[2] % 2 and not (r[:2] == ("t", 1) and 301 <= r[2] <= 399)]
    assert sorted(map(str, map(tuple, left.where("offset is not null").collect()))) == sorted(map(str, want))
    assert left.where("offset is null").count() == 2
    left.explain()
    assert "Join" not in capsys.readouterr().out


def test_dead_letters_keep_their_error(spark, tmp_path):
    out = str(tmp_path / "out")
    write(tmp_path / "in", "1.json", [message("c", 1, {"id": 1, "v": "a"}), message("c", 2, {"id": "no", "v": "a"}),
                                      {"topic": "srv.sales.items", "value": "{bad"}, {"topic": "srv.sales.items", "value": '{"op": "c"}'},
                                      {"topic": "srv.sales.items", "value": None}, message("c", 3, {"other": 5}, "srv.sales.others")])
    stream = changes.read_changes(spark, str(tmp_path / "in"))
    changes.land_changes(stream, out, str(tmp_path / "cp"), row_schemas={"cdc_db_sales_items": ROW}).awaitTermination()
    errors = sorted(r["error"] for r in changes.read_dead(spark, out).collect())
    assert errors == [changes.NOT_FITTING, changes.NOT_FITTING, changes.NOT_JSON]
    assert changes.read_landing(spark, out).count() == 3 and changes.read_landing(spark, out, "cdc_db_sales_items").count() == 2


def test_order_and_repeats_of_events_change_nothing(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(20), f"v{i}", i // 3, i % 5 == 0, i) for i in range(200)]
    schema = "id int, v string, version long, is_deleted boolean, ingest_seq long"
    want = sorted(latest_version(spark.createDataFrame(rows, schema), ["id"]).collect())
    rng.shuffle(rows)
    assert sorted(latest_version(spark.createDataFrame(rows + rows[:70], schema), ["id"]).collect()) == want


def test_route_names(spark):
    df = spark.createDataFrame([("s.pub.it-em",), ("plain",)], "t string")
    assert [r[0] for r in df.select(changes.route_table(F.col("t"), "b")).collect()] == ["cdc_b_pub_it_em", "plain"]


def test_backfill_never_beats_a_change(spark):
    landing = spark.createDataFrame([(1, "new", 7, False, 3)], "id int, v string, version long, is_deleted boolean, ingest_seq long")
    source = spark.createDataFrame([(1, "old", 0), (2, "two", 0)], "ID int, V string, extra int")
    rows = landing.unionByName(changes.backfill(source, landing))
    assert {(r["id"], r["v"]) for r in current_view(rows, ["id"]).collect()} == {(1, "new"), (2, "two")}


# ---------------------------------------------------------------- warehouse

def query(views):
    o, c = views["orders"], views["customer"]
    return o.join(c, o["cust"] == c["c_id"], "left").select("o_id", "cust", "amount", "name")


WH = warehouse.Warehouse(query, ["o_id"], {"orders": ["o_id"], "customer": ["c_id"]}, {"orders": ["o_id"], "customer": ["cust"]})
SCHEMAS = {"orders": "o_id int, cust int, amount int, version long, is_deleted boolean",
           "customer": "c_id int, name string, version long, is_deleted boolean"}


def pairs(views):
    """Keyed by both tables: no table drives it."""
    o, c = views["orders"], views["customer"]
    return o.join(c, o["cust"] == c["c_id"]).select("o_id", "c_id", "amount", "name")


PAIRS = warehouse.Warehouse(pairs, ["o_id", "c_id"], WH.table_keys, {"orders": ["o_id"], "customer": ["c_id"]})


@pytest.mark.parametrize("WH", [WH, PAIRS], ids=["driven", "pairs"])
def test_random_changes_keep_the_target_equal_to_the_query(spark, tmp_path, WH):
    rng = random.Random(11)
    target, version = None, 0
    for number in range(1, 6):
        changed, landing = {}, {}
        for table in SCHEMAS:
            rows = []
            for _ in range(12 if number > 1 else 25):
                version += 1
                key, gone = rng.randrange(15), rng.random() < 0.25
                rows.append((key, rng.randrange(15), rng.randrange(9), version, gone) if table == "orders"
                            else (key, f"n{rng.randrange(5)}", version, gone))
            folder = f"{tmp_path}/{table}/batch={number}"
            spark.createDataFrame(rows, SCHEMAS[table]).withColumn("ingest_seq", F.lit(number).cast("long")).write.parquet(folder)
            changed[table] = spark.read.parquet(folder)
            landing[table] = spark.read.parquet(f"{tmp_path}/{table}/batch=*")
        out = warehouse.join_refresh(changed, landing, target, WH, number)
        for _ in range(2):  # a repeated batch rewrites its folder
            out.write.mode("overwrite").parquet(f"{tmp_path}/target/batch={number}")
        target = spark.read.parquet(f"{tmp_path}/target/batch=*")
        want = WH.query(warehouse.views(landing, WH))
        got = current_view(target, WH.keys, sequence=None).select(*want.columns)
        assert sorted(got.collect(), key=repr) == sorted(want.collect(), key=repr)


def test_refresh_appends_only_touched_rows(spark):
    def landing_of(extra):
        orders = spark.createDataFrame([(i, i % 3, i, 1, False, 1) for i in range(30)], SCHEMAS["orders"] + ", ingest_seq long")
        customer = spark.createDataFrame([(i, f"n{i}", 1, False, 1) for i in range(3)] + extra, SCHEMAS["customer"] + ", ingest_seq long")
        return {"orders": orders, "customer": customer}

    target = warehouse.populate(landing_of([]), WH)
    change = [(2, "renamed", 5, False, 2)]
    changed = {"customer": spark.createDataFrame(change, SCHEMAS["customer"] + ", ingest_seq long")}
    out = warehouse.join_refresh(changed, landing_of(change), target, WH, 1).collect()
    assert len(out) == 10 and {r["name"] for r in out} == {"renamed"}


@pytest.mark.parametrize("every", [None, 2])
def test_streamed_warehouse_batches(spark, tmp_path, every):
    source = tmp_path / "in"

    def split(batch):
        rows = batch.select(F.from_json("value", "o_id int, cust int, amount int, name string, lsn long, gone boolean").alias("r")).select("r.*")
        return {
            "orders": rows.filter("o_id is not null").select("o_id", "cust", "amount", F.col("lsn").alias("version"), F.col("gone").alias("is_deleted")),
            "customer": rows.filter("name is not null").select(F.col("cust").alias("c_id"), "name", F.col("lsn").alias("version"), F.col("gone").alias("is_deleted")),
        }

    def run():
        stream = changes.read_changes(spark, str(source), maxFilesPerTrigger=1)
        warehouse.run_warehouse(stream, split, WH, str(tmp_path / "landing"), str(tmp_path / "target"), str(tmp_path / "cp"),
                                compact_every=every).awaitTermination()

    def send(name, *rows):
        write(source, name, [{"topic": "t", "partition": 0, "offset": 0, "value": json.dumps(r)} for r in rows])

    send("1.json", {"o_id": 1, "cust": 7, "amount": 5, "lsn": 1, "gone": False}, {"o_id": 2, "cust": 8, "amount": 6, "lsn": 2, "gone": False})
    run()
    send("2.json", {"cust": 7, "name": "Ann", "lsn": 3, "gone": False}, {"o_id": 2, "cust": 8, "amount": 6, "lsn": 4, "gone": True})
    run()
    send("3.json", {"o_id": 2, "cust": 7, "amount": 9, "lsn": 3, "gone": False}, {"o_id": 3, "cust": 7, "amount": 1, "lsn": 6, "gone": False})
    run()
    send("4.json", {"cust": 7, "name": "Eve", "lsn": 8, "gone": False})
    run()
    got = current_view(spark.read.parquet(f"{tmp_path}/target/batch=*"), ["o_id"], sequence=None)
    # The late row of order 2 is older than its delete.
    assert sorted((r["o_id"], r["name"]) for r in got.collect()) == [(1, "Eve"), (3, "Eve")]
    folders = len(list((tmp_path / "target").glob("batch=*")))
    assert folders == (4 if every is None else 2)


def test_compacting_batches_keeps_the_latest_rows_and_deletes(spark, tmp_path):
    rows = [(1, "a", 5, False, 1), (1, "b", 4, False, 2), (2, "c", 1, False, 1), (2, "c", 9, True, 3)]
    for i, row in enumerate(rows):
        spark.createDataFrame([row], "id int, v string, version long, is_deleted boolean, ingest_seq long") \
            .write.parquet(f"{tmp_path}/t/batch={i}")
    assert warehouse.compact_batches(spark, f"{tmp_path}/t", ["id"], before="batch=3") == 3
    left = sorted(p.name for p in (tmp_path / "t").glob("batch=*"))
    assert len(left) == 2 and left[0].startswith("batch=2.") and left[1] == "batch=3"
    assert warehouse.compact_batches(spark, f"{tmp_path}/t", ["id"]) == 2
    got = spark.read.parquet(f"{tmp_path}/t/batch=*")
    assert sorted((r["id"], r["v"], r["is_deleted"]) for r in got.collect()) == [(1, "a", False), (2, "c", True)]
    assert warehouse.compact_batches(spark, f"{tmp_path}/t", ["id"]) == 0


def test_backfill_sets_bad_values_aside(spark):
    landing = spark.createDataFrame([], "k long, v string, version long, is_deleted boolean")
    source = spark.createDataFrame([("1", "a"), ("x", "b"), (None, "c")], "k string, v string")
    assert sorted((r["k"] or 0, r["v"]) for r in changes.backfill(source, landing).collect()) == [(0, "c"), (1, "a")]
    (bad,) = changes.backfill_rejects(source, landing).collect()
    assert bad["error"] == "no fitting value for k" and '"x"' in bad["value"] and bad["failed_at"] is not None
