"""Refreshes from bucketed state: equal to the query, and only touched buckets are read."""

import random

import pytest
from pyspark.sql import functions as F

from evenkeel.streaming import buckets

SCHEMAS = {"orders": "o_id int, cust long, seller int, amount int, version long, is_deleted boolean",
           "customer": "c_id int, name string, home short, version long, is_deleted boolean",
           "seller": "s_id int, title string, place int, version long, is_deleted boolean",
           "nation": "n_id int, land string, version long, is_deleted boolean"}


def query(views):
    """Orders with their customer and seller, and the nations of both."""
    o, c, s, n = (views[t] for t in ("orders", "customer", "seller", "nation"))
    home, place = n.select(F.col("n_id").alias("h_id"), F.col("land").alias("home_land")), n.select(F.col("n_id").alias("p_id"), F.col("land").alias("place_land"))
    joined = o.join(c, o["cust"] == c["c_id"], "left").join(home, F.col("home") == F.col("h_id"), "left")
    joined = joined.join(s, F.col("seller") == s["s_id"], "left").join(place, F.col("place") == F.col("p_id"), "left")
    return joined.select(F.col("o_id").alias("id"), "amount", "name", "home_land", "title", "place_land")


WH = buckets.BucketedWarehouse(
    query, ["id"], "orders", {"orders": ["o_id"], "customer": ["c_id"], "seller": ["s_id"], "nation": ["n_id"]},
    [buckets.Link("orders", ["cust"], "customer"), buckets.Link("orders", ["seller"], "seller"),
     buckets.Link("customer", ["home"], "nation"), buckets.Link("seller", ["place"], "nation")], buckets=8)


def current(history, table):
    last = {}
    for row in history[table]:
        if row[0] not in last or row[-2] >= last[row[0]][-2]:
            last[row[0]] = row
    return {k: r for k, r in last.items() if not r[-1]}


def by_hand(history):
    o, c, s, n = (current(history, t) for t in ("orders", "customer", "seller", "nation"))
    out = []
    for i, cust, seller, amount, *_ in o.values():
        customer, sold = c.get(cust), s.get(seller)
        out.append((i, amount, customer and customer[1], n[customer[2]][1] if customer and customer[2] in n else None,
                    sold and sold[1], n[sold[2]][1] if sold and sold[2] in n else None))
    return sorted(out, key=repr)


def row_of(rng, table, version):
    gone, one, other = rng.random() < 0.2, rng.randrange(9), rng.choice([None, *range(9)])
    if table == "orders":
        return rng.randrange(14), other, one, rng.randrange(100), version, gone
    if table == "nation":
        return one, f"land {rng.randrange(50)}", version, gone
    return one, f"{table} {rng.randrange(50)}", other, version, gone


def test_random_changes_over_two_hops(spark, tmp_path):
    rng, history, version, path = random.Random(4), {t: [] for t in SCHEMAS}, 0, str(tmp_path / "state")
    for number in range(1, 4):
        changed = {}
        for table in SCHEMAS if number == 1 else rng.sample(list(SCHEMAS), 2):
            rows = []
            for _ in range(18 if number == 1 else 4):
                version += 1
                rows.append(row_of(rng, table, version))
            history[table] += rows
            changed[table] = spark.createDataFrame(rows, SCHEMAS[table])
        for _ in range(2 if number == 2 else 1):  # a repeated batch changes nothing
            buckets.refresh(spark, path, WH, changed, number)
        if number == 2:
            replaced = [buckets.compact_buckets(spark, path, WH, t, most=1) for t in ("orders", "nation", buckets.TARGET, WH.links[0].index)]
            assert sum(replaced) > 0 and buckets.compact_buckets(spark, path, WH, "orders", most=1) == 0
        got = sorted(map(tuple, buckets.read_target(spark, path, WH).collect()), key=repr)
        assert got == by_hand(history), number


def test_a_small_batch_reads_its_buckets_only(spark, tmp_path):
    wh = buckets.BucketedWarehouse(WH.query, WH.keys, WH.driving, WH.table_keys, WH.links, buckets=64)
    path = str(tmp_path / "state")
    state = buckets.BucketState(spark, path, 64)

    def rows(table, n, version, **over):
        df = spark.range(n).select(F.col("id").cast("int"))
        values = {"orders": [F.col("id"), (F.col("id") % 200).cast("long"), (F.col("id") % 50).cast("int"), F.lit(1)],
                  "customer": [F.col("id"), F.lit("c"), (F.col("id") % 20).cast("short")],
                  "seller": [F.col("id"), F.lit("s"), (F.col("id") % 20).cast("int")], "nation": [F.col("id"), F.lit("n")]}[table]
        return df.select(*values, F.lit(version).cast("long"), F.lit(False)).toDF(*[c.split()[0] for c in SCHEMAS[table].split(", ")])

    buckets.refresh(spark, path, wh, {t: rows(t, n, 1) for t, n in (("orders", 2000), ("customer", 200), ("seller", 50), ("nation", 20))}, 1)
    assert buckets.read_target(spark, path, wh).count() == 2000
    one = rows("customer", 200, 2).filter("c_id = 7").withColumn("name", F.lit("new"))
    read = buckets.refresh(spark, path, wh, {"customer": one}, 2)
    moved = [r.o_id for r in rows("orders", 2000, 1).filter("cust = 7").collect()]
    own = lambda ids: set(state.numbers(spark.createDataFrame([(i,) for i in ids], "k int"), ["k"]))
    assert read["orders"] == read["target"] == own(moved) and len(moved) == 10
    assert read["customer"] == own([7]) and read["nation"] <= own([7 % 20, *[i % 50 % 20 for i in moved]])
    assert len(read[wh.links[0].index]) == 1 and wh.links[2].index not in read
    # The folders of the batch lie in those buckets alone.
    new = [n for n, f in state.folders("target", range(64)).items() if f[-1].endswith("=000000000002")]
    assert set(new) == own(moved)
    assert buckets.read_target(spark, path, wh).filter("name = 'new'").count() == 10


def test_links_are_checked(spark, tmp_path):
    bad = buckets.BucketedWarehouse(query, ["id"], "orders", {"orders": ["o_id"], "other": ["x"]}, [])
    with pytest.raises(ValueError):
        bad.order()
    loop = buckets.BucketedWarehouse(query, ["id"], "a", {"a": ["x"], "b": ["y"], "c": ["z"]}, [
        buckets.Link("a", ["q"], "b"), buckets.Link("b", ["q"], "c"), buckets.Link("c", ["q"], "b")])
    with pytest.raises(ValueError):
        loop.order()
    with pytest.raises(ValueError):
        buckets.refresh(spark, str(tmp_path / "s"), WH, {"orders": spark.createDataFrame([], SCHEMAS["orders"])}, 1)


def test_later_columns_and_no_rows(spark, tmp_path):
    wh = buckets.BucketedWarehouse(lambda v: v["orders"], ["o_id"], "orders", {"orders": ["o_id"]}, [], buckets=4)
    path = str(tmp_path / "s")
    buckets.refresh(spark, path, wh, {"orders": spark.createDataFrame([], SCHEMAS["orders"])}, 1)
    buckets.refresh(spark, path, wh, {"orders": spark.createDataFrame([(1, 2, 3, 4, 1, False)], SCHEMAS["orders"])}, 2)
    buckets.refresh(spark, path, wh, {"orders": spark.createDataFrame([(2, 2, 3, 4, "x", 2, False)], SCHEMAS["orders"].replace("version", "note string, version"))}, 3)
    assert sorted((r.o_id, r.note) for r in buckets.read_target(spark, path, wh).collect()) == [(1, None), (2, "x")]


def test_own_pairs_are_not_read_back(spark, tmp_path):
    """A batch that moves an order to a changed customer reads the older pairs of its buckets, not its own."""
    path, frame = str(tmp_path / "s"), lambda table, *rows: spark.createDataFrame(list(rows), SCHEMAS[table])
    index = WH.links[0].index
    first = {"orders": frame("orders", (1, 1, 1, 5, 1, False), (2, 2, 1, 6, 1, False)), "customer": frame("customer", (1, "a", 1, 1, False), (2, "b", 1, 1, False)),
             "seller": frame("seller", (1, "s", 1, 1, False)), "nation": frame("nation", (1, "n", 1, False))}
    read = buckets.refresh(spark, path, WH, first, 1)
    assert not any(read[link.index] for link in WH.links) and not read["target"]
    moved = {"orders": frame("orders", (1, 2, 1, 5, 2, False)), "customer": frame("customer", (2, "c", 1, 2, False))}
    read = buckets.refresh(spark, path, WH, moved, 2)
    assert len(read[index]) == 1
    assert sorted((r.id, r.name) for r in buckets.read_target(spark, path, WH).collect()) == [(1, "c"), (2, "c")]
    buckets.refresh(spark, path, WH, {"orders": frame("orders", (2, 2, 1, 6, 3, True))}, 3)
    buckets.refresh(spark, path, WH, {"orders": frame("orders", (2, 2, 1, 6, 3, True))}, 3)  # again
    assert [(r.id, r.name) for r in buckets.read_target(spark, path, WH).collect()] == [(1, "c")]
