"""Phrases, curriculum and fill-in-the-middle: brute force, small cases, odd inputs."""

import collections
import hashlib
import re
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evenkeel.llm import collocations, curriculum, fill_in_middle as fim

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n int, rank string, output string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, columns with the names of results."""
    long = " ".join(f"w{i % 977}x{i % 211}" for i in range(9_000))
    rows = [(1, "a b c. a b c, A B", "en", "s1"), (2, None, None, None), (3, "", "en", "s1"), (None, "x y z", "en", "s2"), (None, None, None, "s2"),
            (4, " \t\n ", "de", "s2"), (5, long, "en", None), (5, long, "en", None), (6, "tail <M> inside", "de", "s1"), (7, "ça và 日本 語\n\nfin ", "fr", "日"),
            (8, "one two three", "fr", "日"), (9, "word", "de", "S"), (9, "other words here", "de", "S")]
    return spark.createDataFrame([(*r, 7, "r", "o") for r in rows], SCHEMA)


def phrases_by_hand(rows, least, share, top):
    counts, sizes = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            lang = lang or "und"
            sizes[lang] += len(words)
            for k in range(1, 5):
                counts[lang].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        most = collections.Counter()
        for p, a in f.items():
            if a >= least:
                for i in range(len(p)):
                    for j in range(i + 1, len(p) + 1):
                        if j - i < len(p):
                            most[p[i:j]] = max(most[p[i:j]], a)
        found = []
        for p, a in f.items():
            if len(p) > 1 and a >= least and 100 * most[p] < share * a:
                score, k, left, right = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, sizes[lang], -score))
    return sorted(out)


def mined(df, **options):
    return sorted(map(tuple, collocations.phrases(df, **options).collect()))


def test_phrases_by_hand(spark, odd, monkeypatch):
    rng = np.random.default_rng(5)
    words = ["the", "of", "New", "York", "times", "a", "b", "c"]
    texts = [(" ".join(rng.choice(words, rng.integers(0, 30), p=[.3, .1, .1, .1, .1, .1, .1, .1])).replace("c b", "c, b"), ["en", "de", None][i % 3]) for i in range(300)]
    df = spark.createDataFrame([(*t, i) for i, t in enumerate(texts)], "text string, lang string, rank int")
    for options in ({"least": 5, "share": 80, "top": 20}, {"least": 2, "share": 50, "top": 2000}):
        assert mined(df, **options) == phrases_by_hand(texts, **options)
    rows = [(r.text, r.lang) for r in odd.collect()]
    want = phrases_by_hand(rows, 2, 80, 50)
    assert mined(odd, least=2, share=80, top=50) == want and len(want) == 50
    assert mined(odd, least=30) == [] and mined(odd.where("false")) == []


def test_hot_prefixes_are_split(spark, monkeypatch):
    """Segments so small that most prefixes are hot, and many flushes of a task."""
    monkeypatch.setattr(collocations, "SEGMENT", 40)
    monkeypatch.setattr(collocations, "BUFFER", 64)
    rng = np.random.default_rng(6)
    texts = [(" ".join(rng.choice(["x", "y", "z", "u", "v"], 40)), "en") for _ in range(120)]
    df = spark.createDataFrame(texts, "text string, lang string").repartition(3)
    assert mined(df, least=4, share=80, top=500) == phrases_by_hand(texts, 4, 80, 500)


def test_bitmap_that_lets_all_through(spark, monkeypatch):
    full = lambda hashes, column: np.full(1 << 13, 255, np.uint8)
    monkeypatch.setattr(collocations, "_bitmap", full)
    texts = [("p q r s t " * 3 + f"rare{i}", "en") for i in range(5)]
    df = spark.createDataFrame(texts, "text string, lang string")
    assert mined(df, least=5, share=80, top=100) == phrases_by_hand(texts, 5, 80, 100)


def levels_by_hand(sizes, weights, share, repeats):
    budget, full = share * sum(sizes), set()
    while True:
        left = [i for i in range(len(sizes)) if i not in full]
        level = (budget - sum(repeats * sizes[i] for i in full)) / sum(weights[i] for i in left) if left else Fraction(0)
        more = {i for i in left if level * weights[i] >= repeats * sizes[i]}
        if not more:
            return [repeats * s if i in full else level * w for i, (s, w) in enumerate(zip(sizes, weights))]
        full |= more


def test_mix_by_hand(spark):
    rng = np.random.default_rng(3)
    names = ["a", "B", "é", "z", "aa", None, "hot"]
    rows = [(i, "w " * int(rng.integers(0, 40)), names[min(i % 12, 6)]) for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for share, repeats in ((Fraction(3, 2), 2), (Fraction(1, 3), 1), (Fraction(5, 2), 3)):
        got = curriculum.mix(df, share=share, repeats=repeats).toPandas()
        ranks = sorted(set(names), key=lambda s: (s is None, s or ""))
        sizes = [sum(len(t.split()) for _, t, s in rows if s == name) for name in ranks]
        want = levels_by_hand(sizes, [[3, 1, 2][i % 3] for i in range(len(ranks))], share, repeats)
        for name, size, target in zip(ranks, sizes, want):
            part = got[got.source.isna() if name is None else got.source == name]
            assert set(part["size"].groupby(part.index).sum()) and part["size"].sum() == size and (part.source_size == size).all()
            assert part.target.iloc[0] == pytest.approx(float(target)) and abs(part.taken.sum() - float(target)) <= 0.5
            assert (part.taken <= repeats * part["size"]).all()
        assert [len(p) > 0 for p in got.positions] == (got.taken > 0).tolist()
        assert all(0 <= t <= 1 for p in got.positions for t in p)


def test_positions_follow_the_schedules(spark):
    """In a short span of training, sources come in the shares of their schedules there."""
    df = spark.range(60_000).select(F.col("id").alias("doc_id"), F.lit("one two three four five").alias("text"), (F.col("id") % 3).cast("string").alias("source"))
    mixed = curriculum.mix(df, share=Fraction(1, 2), repeats=2)
    order = curriculum.training_order(mixed).collect()
    assert [r.position for r in order] == sorted(r.position for r in order)
    for a in (0.0, 0.45, 0.9):
        seen = collections.Counter(r.doc_id % 3 for r in order if a <= r.position < a + 0.1)
        want = [4 - 2 * (a + 0.05), 2 * (a + 0.05), 2]
        for i in range(3):
            assert seen[i] / sum(seen.values()) == pytest.approx(want[i] / sum(want), abs=0.01)


def test_times_invert_the_integral(spark):
    schedule = ((0, 0), (0.25, 3), (0.5, 3), (0.75, 0), (1, 0))
    shares = np.linspace(0, 1, 41)
    df = spark.createDataFrame([(float(x),) for x in shares], "u double").select("u", curriculum.time_of(F.col("u"), schedule).alias("t"))
    for u, t in df.collect():
        grid = np.linspace(0, t, 20_001)
        area = np.trapezoid(np.interp(grid, [x for x, _ in schedule], [w for _, w in schedule]), grid)
        assert area / float(curriculum.integral(schedule)) == pytest.approx(u, abs=1e-6)
    with pytest.raises(ValueError):
        curriculum.integral(((0, 1), (0.5, 1)))


def test_mix_of_odd_rows(spark, odd):
    a, b = (sorted(map(tuple, curriculum.mix(odd.repartition(n)).drop("positions").collect()), key=repr) for n in (1, 5))
    assert a == b and len(a) == odd.count()
    for _, _, size, _, _, taken in a:
        assert 0 <= taken <= 2 * size
    blank = curriculum.mix(odd.where("length(trim(coalesce(text, ''))) < 2")).collect()
    assert blank and all(r.taken == 0 and r.positions == [] and r.target == 0 for r in blank)
    assert curriculum.mix(odd.where("false")).count() == 0


@pytest.mark.parametrize("values", [
    [0], list(range(70_000)), list(range(0, 200_000, 3)), [1, 5, 6, 7, 65_535, 65_536, 65_537, 400_000], list(range(10, 5_000, 2)),
    sorted(np.random.default_rng(1).choice(300_000, 40_000, replace=False).tolist())])
def test_boundary_sets_select(values):
    found = fim.BoundarySet(np.array(values, np.int64))
    assert len(found) == len(values)
    for k in {0, len(values) // 2, len(values) - 1, *np.random.default_rng(2).integers(0, len(values), 200).tolist()}:
        assert found.select(k) == values[k]
    with pytest.raises(IndexError):
        found.select(len(values))


def test_kinds_of_containers():
    kinds = {type(c) for values in (range(100), range(0, 3000, 2), range(0, 60_000, 2)) for c in fim.BoundarySet(np.array(values)).containers}
    assert kinds == {fim.RunContainer, fim.ArrayContainer, fim.BitmapContainer}


def cut_by_hand(doc_id, text, seed=42, rate=50, spm=80):
    text = text or ""
    tokens = TOKEN.findall(text)
    digest = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i:i + 8], 16) for i in (0, 8, 16, 24)]
    if not text or h[2] % 100 >= rate or any(m in text for m in ("<P>", "<S>", "<M>")):
        return doc_id, text, len(tokens), "plain", None, None
    a, b = sorted(x % (len(tokens) + 1) for x in h[:2])
    prefix, middle, suffix = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h[3] % 100 < spm:
        return doc_id, f"<S>{suffix}<P>{prefix}<M>{middle}", len(tokens), "spm", len(prefix), len(middle)
    return doc_id, f"<P>{prefix}<S>{suffix}<M>{middle}", len(tokens), "psm", len(prefix), len(middle)


def test_cuts_by_hand(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    rows += [(100 + i, t) for i in range(12) for t in ("a  b\tc\n", "  lead", "<", "x<P y", "日本語 テ　スト", "é" * 50, "a " * 70_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for options in ({}, {"rate": 100, "spm": 50}):
        got = fim.fill_in_middle(df, **options)
        assert sorted(map(tuple, got.collect()), key=repr) == sorted((cut_by_hand(*r, **options) for r in rows), key=repr)
        back = got.select("doc_id", fim.restored(F.col("output"), F.col("form")).alias("text"))
        assert sorted(map(tuple, back.collect()), key=repr) == sorted(((i, t or "") for i, t in rows), key=repr)


def test_cuts_carry_columns(spark, odd):
    assert fim.fill_in_middle(odd, "lang", "rank").columns[-2:] == ["lang", "rank"]
    with pytest.raises(ValueError):
        fim.fill_in_middle(odd, "n")
    assert fim.fill_in_middle(odd.where("false")).count() == 0


def test_words_end_at_breaks():
    batch = pa.record_batch({"text": ["A b.c\td\ne", "b"], "lang": ["en", "de"]})
    (words, names), = collocations.read_words(iter([batch]))
    assert words.follows.tolist() == [True, False, True, False, False, False]
    assert sorted(set(names.values())) == ["de", "en"] and words.hashes[1] != words.hashes[5]
