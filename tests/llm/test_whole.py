"""Cases in which a part of the input once did not count."""

import collections

import numpy as np
import pytest

from evenkeel.llm import line_crf, masked_lm, toxicity


def test_rare_words_are_scored_as_themselves(spark, monkeypatch):
    """Two words of one length have their own shares of its unit, looked up or joined."""
    common = " ".join(f"c{i}" for i in range(1100)) + " "
    texts = [(1, common * 9), (2, "zzzza zzzza zzzza"), (3, "zzzzb"), (3, "zzzzb"), (None, "zzzzc zzzza"), (4, None), (5, "")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    counts = masked_lm.count_words(df).cache()
    units = masked_lm.choose_units(df, counts)
    flat = masked_lm.Network.new().flat
    score = lambda *c: {(r[0], r[1]): r[2] for r in masked_lm.score_documents(df, units, flat, *c).collect()}
    plain, want = score(), {}
    words = collections.Counter(w for _, t in texts for w in (t or "").split())
    top = {r["word"] for r in counts.orderBy(masked_lm.F.desc("n"), "word").limit(1007).collect()}
    assert all(n >= 9 for w, n in words.items() if w.startswith("c")) and len(top) == 1007
    in_class = {r["length"]: r["n"] for r in counts.where(~masked_lm.F.col("word").isin(list(top))).groupBy("length").agg(masked_lm.F.sum("n").alias("n")).collect()}
    for i, text in texts[1:]:
        split = (text or "").split()
        want[i, len(split)] = sum(np.log(words[w] / in_class[5]) for w in split)
    for most in (0, masked_lm.HELD):
        monkeypatch.setattr(masked_lm.choose_shares, "__defaults__", (most,))
        got = score(counts)
        assert len(got) == len(plain) == 6
        for key, more in want.items():
            assert got[key] - plain[key] == pytest.approx(more, abs=1e-5), key
    assert got[2, 3] / 3 > got[3, 1]


def test_toxicity_learns_from_twelve_thousand_labels(spark, monkeypatch):
    """All of 9000 labelled documents are learned from, also if most are toxic; rarer features stay behind."""
    n, seen = 9_000, {}
    texts = [(i, f"{'awful' if i % 3 else 'lovely'} {'late' if i == 8_999 else 'day'} word{i % 50}x") for i in range(n)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(n)], "doc_id long, toxic int")
    kept = toxicity.train
    monkeypatch.setattr(toxicity, "train", lambda rows, marks, *rest: seen.update(rows=rows, marks=marks) or kept(rows, marks, *rest))
    model = toxicity.fit(docs, labels)
    assert len(seen["rows"]) == n and seen["marks"].sum() == 6_000
    every = toxicity.features_of([t for _, t in texts])
    held = np.bincount(np.concatenate(every), minlength=1 << toxicity.TABLE_BITS)
    for got, all_ in zip(seen["rows"], every):
        assert got.tolist() == [p for p in all_.tolist() if held[p] >= toxicity.LEAST_DOCUMENTS]
    whole = kept(every, np.array([int(i % 3 > 0) for i in range(n)]))
    assert model.features.tolist() == whole.features.tolist() and model.weights == pytest.approx(whole.weights)


def test_every_mention_is_swapped_for_every_other_term(spark, monkeypatch):
    """Mentions late in a text and in late documents count, and equal the features of whole sentences."""
    texts = ["women spoke. " * 30 + "Then, muslim muslimness men came to women!\nold 'old' gay women", "nobody", None,
             "women and men and hombres, (White) whitewash", "blind deaf"]
    want = collections.Counter()
    for a, b in toxicity.swaps(texts):
        old, new = (set(p.tolist()) for p in toxicity.features_of([a, b]))
        want[tuple(sorted(old - new)), tuple(sorted(new - old))] += 1
    assert toxicity.changes(texts) == want
    assert sum(want.values()) == (33 + 3) * 7 + 6 + 2 * 4 + 4 + 7 + 2 * 4
    seen = {}
    monkeypatch.setattr(toxicity, "train", lambda rows, marks, pairs: seen.update(pairs=pairs))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 300)], "doc_id long, text string")
    toxicity.fit(docs, spark.createDataFrame([(i, i % 2) for i in range(len(texts) * 300)], "doc_id long, toxic int"))
    assert seen["pairs"] == {k: 300 * n for k, n in want.items()}


def test_penalty_of_changes_is_that_of_sentences():
    texts = [f"{w} are {k}" for w in ("women", "men", "gay", "muslim") for k in ("awful awfully", "lovely", "here")] * 5
    marks = np.array(["awful" in t or "women" in t for t in texts], int)
    rows = toxicity.features_of(texts)
    by_sentence, by_change = (toxicity.train(rows, marks, p) for p in (toxicity.swaps(texts), toxicity.changes(texts)))
    assert by_sentence.features.tolist() == by_change.features.tolist() and by_sentence.weights == pytest.approx(by_change.weights)


def test_field_learns_from_all_lines(spark, monkeypatch):
    """Lines after the first 200 count, and a long text's lines are summed exactly in stretches."""
    clean, junk = "This is a plain sentence of words.", "### $$$ ||| 000"
    texts = [(i, "\n".join([clean] * 250 + [junk] * 400 if i % 2 else [clean] * (3 + i))) for i in range(8)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(8)], "doc_id long, quality int")
    seen, kept = {}, line_crf.train
    monkeypatch.setattr(line_crf, "train", lambda *given: seen.update(given=given) or kept(*given))
    field = line_crf.fit(docs, labels)
    features, marks, first = seen["given"]
    assert np.diff(first).tolist() == [t.count("\n") + 1 for _, t in texts]
    judged = {r["doc_id"]: r["content_words"] for r in line_crf.judge(docs, field).collect()}
    assert judged[0] == 3 * 7 and judged[1] < 250 * 7 + 400 * 4
    for stretch in (1, 7, 1 << 20):
        monkeypatch.setattr(line_crf, "STRETCH", stretch)
        monkeypatch.setattr(line_crf, "ROUNDS", 20)
        got = kept(features, marks, first)
        monkeypatch.setattr(line_crf, "STRETCH", 512)
        want = kept(features, marks, first)
        assert got.emit == pytest.approx(want.emit, abs=1e-9) and got.move == pytest.approx(want.move, abs=1e-9)
