"""Similarity joins against scoring all pairs."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from evenkeel.functions.similarity import jaro_scores
from evenkeel.operators import matching, similarity_join
from evenkeel.plans import QUERIES


def names(n, seed):
    rng = np.random.default_rng(seed)
    first = ["anna", "maria", "johannes", "peter", "li", "søren", "zoë", "maximilian"]
    last = ["schmidt", "smith", "smyth", "garcia", "ngo", "o'hara", "müller", "mueller"]
    out = []
    for _ in range(n):
        text = list(f"{rng.choice(first)} {rng.choice(last)} {rng.integers(0, 40)}")
        for _ in range(rng.integers(0, 3)):
            text[rng.integers(0, len(text))] = str(rng.choice(list("aeioxyz ")))
        out.append("".join(text))
    return out


@pytest.mark.parametrize("threshold", [60, 80, 90, 97.5])
def test_values_equal_brute_force(spark, threshold):
    a, b = [*names(90, 1), "", None, "x", "same", "日本"], [*names(110, 2), "", None, "x", "y", "same", "日本語"]
    frames = [spark.createDataFrame([(x,) for x in v], "value string") for v in (a, b)]
    got = {(r["left"], r["right"]): r["score"] for r in similarity_join.similar_values(*frames, threshold).collect()}
    pairs = [(x, y) for x in sorted({x for x in a if x}) for y in sorted({y for y in b if y})]
    scores = jaro_scores(pd.Series([x for x, _ in pairs]), pd.Series([y for _, y in pairs]))
    want = {p: s for p, s in zip(pairs, scores) if s >= threshold}
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in want) and ("same", "same") in got


def test_few_pairs_are_scored(spark):
    df = spark.createDataFrame([(x,) for x in names(300, 3)], "value string")
    n = df.distinct().count()
    scored = similarity_join.candidate_values(df, df, 92).count()
    found = similarity_join.similar_values(df, df, 92).count()
    assert found <= scored < n * n / 4


def test_records_equal_brute_force(spark):
    rows = [(i, a, b if i % 7 else None, float(i)) for i, (a, b) in enumerate(zip(names(60, 4), names(60, 5)))]
    df = spark.createDataFrame(rows, "id long, name string, other string, latitude double")
    got = similarity_join.match_records_joined(df, df.withColumnRenamed("id", "probe_id"), ["name", "other", "latitude"], 85)
    one = df.withColumn("block", F.lit(1))
    want = matching.match_records(one, one.withColumnRenamed("id", "probe_id"), ["name", "other"], 85, block_on=["block"])
    show = lambda x: sorted((r["id"], int(r["probe_id"]), round(r["score"], 6)) for r in x.collect())
    assert show(got) == show(want) and len(show(got)) > 60


@pytest.mark.parametrize("chunk", [4, 2048])
def test_links_equal_matches(spark, monkeypatch, chunk):
    """Copies are matched once and counted each; lengths of several bands meet; empty and null match nothing."""
    monkeypatch.setattr(similarity_join, "CHUNK", chunk)
    texts = [*names(70, 6), *names(30, 6), None, "", "x", "日本語", "日本誤", *[("lorem ipsum " * 9)[:n] for n in (60, 64, 65, 66, 70, 100)]]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, name string")
    probes = df.where("id % 3 < 2").withColumnRenamed("id", "probe_id")
    want = {}
    for r in similarity_join.match_records_joined(df, probes, ["name"], 88).collect():
        want[r["id"]] = want.get(r["id"], 0) + 1
    flat = jaro_scores(pd.Series(np.repeat(np.array(texts, dtype=object), len(texts))), pd.Series(texts * len(texts)))
    scores = flat.reshape(len(texts), -1)[:, np.arange(len(texts)) % 3 < 2]
    assert want == {i: n for i, n in enumerate((scores >= 88).sum(axis=1)) if n}
    got = similarity_join.match_records_joined(df, probes, ["name"], 88, links=True).collect()
    assert {r["id"]: r["n_links"] for r in got} == {i: want.get(i, 0) for i in range(len(texts))} and len(got) == len(texts)
    assert all(r["class_id"] == [t or "" for t in texts].index(r["name"] or "") for r in got)


def test_low_thresholds_and_no_rows(spark):
    none = spark.createDataFrame([], "value string")
    with pytest.raises(ValueError):
        similarity_join.candidate_values(none, none, 30)
    assert similarity_join.similar_values(none, none, 80).count() == 0


def test_joined_parts_give_each_pair(spark, tmp_path):
    """Copies, a repeated key and keys that are null have all their pairs; a null label has none."""
    rows = [(i, f"{('hot', 'cold', 'old')[i % 3]} {('bolt', 'ring')[i % 2]}", f"Brand#{i % 25}", ("LARGE", "SMALL")[i % 5 == 0], i % 50) for i in range(120)]
    rows += [rows[7], (8, *rows[9][1:]), (None, *rows[10][1:]), (None, *rows[10][1:]), (200, None, "Brand#1", "LARGE", 1), (201, "x", "B", "y", None)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    labels = [(r[0], None if None in r[1:] else " ".join(map(str, r[1:]))) for r in rows]
    pairs = [(a, b) for a in labels for b in labels if a[1] and b[1]]
    scores = jaro_scores(pd.Series([a[1] for a, _ in pairs]), pd.Series([b[1] for _, b in pairs]), True)
    want = sorted(str((a[0], b[0], round(float(s), 6))) for (a, b), s in zip(pairs, scores) if s >= 97)
    got = QUERIES["match_records_joined_parts"](spark, str(tmp_path)).select("id", "probe_id", "score").collect()
    assert sorted(str(tuple(r)) for r in got) == want and len(want) > 2 * len(rows)
