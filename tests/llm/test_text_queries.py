"""The operators on Spark: whole results against brute force, and odd inputs."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.dataset as ds
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from evenkeel.llm import count_min, elias_fano, line_crf, masked_lm, merge_automaton, minhash, packing, sharding, toxicity, winnowing
from evenkeel.llm.queries import BYTE_LEVEL, QUERIES, WORD_LEVEL

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
FOLDER = "/root/testdata/sf0.001"
# Word pairs repeat only after 206,147 of them, so no five words come twice.
LONG = " ".join(f"word{i % 977} and{i % 211}" for i in range(40_000))
PASSAGE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"


@pytest.fixture(scope="module")
def table():
    return ds.dataset(f"{FOLDER}/documents.parquet").to_table().to_pandas().sort_values("doc_id").reset_index(drop=True)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, columns with the names of results."""
    rows = [
        (1, PASSAGE + " first", 1, "a", True), (2, "start " + PASSAGE + " end", 2, "b", False), (2, "start " + PASSAGE + " end", 2, "b", False),
        (2, "other text of the same id, quite short", 3, None, None), (3, None, None, "c", True), (4, "", 0, "d", True), (5, " \n\t ", 5, None, None),
        (6, "a", 1, "e", None), (7, "A", 1, "e", None), (8, LONG, 9, "f", True), (9, LONG + " tail", 9, "f", True), (None, PASSAGE, 1, "g", True),
        (None, None, None, None, None), (10, "\n" * 50, 2, "h", True), (11, "idiot " * 30, 2, "h", True), (-5, PASSAGE, 2, "h", False),
        (12, "the " * 200, 1, "i", True), (13, "日本語 のテキスト, ça va? ŭnïcode", 1, "i", True)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words int, c string, kept boolean")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 0), (11, 0, 1), (12, 0, None), (None, 1, 1), (3, None, 0), (99, 1, 1), (2, 1, 0), (8, 7, 9)],
                                 "doc_id long, quality int, toxic int")


def rows(df):
    return df.toPandas()


def query(spark, name):
    found = [n for n in QUERIES if n.startswith(name + "_")]
    assert len(found) == 1
    return rows(QUERIES[found[0]](spark, FOLDER)).set_index("doc_id", drop=False)


def test_token_files(spark, table):
    got, start, library = query(spark, "op4"), 0, Tokenizer.from_file(BYTE_LEVEL)
    assert len(got) == len(table)
    for i, text in zip(table.doc_id, table.text):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        r = got.loc[i]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_runs_of_documents_are_found_by_select(spark):
    docs = spark.createDataFrame([(None if i % 9 == 0 else i // 2, "a " * (i % 7)) for i in range(200)], "doc_id long, text string")
    manifest = elias_fano.write_token_files(docs, BYTE_LEVEL)
    assert manifest.agg({"n_docs": "sum"}).first()[0] == 200
    whole = sorted(map(tuple, elias_fano.read_token_files(manifest).collect()), key=repr)
    file = elias_fano.TokenFile(manifest.first()["path"])
    bounds, n = file.bounds.some(0, file.n_docs + 1), file.n_docs
    assert bounds[0] == 0 and bounds[-1] == file.n_tokens and (np.diff(bounds) >= 1).all()
    for a in range(0, n, 3):  # runs of any length, found by select, are the parts of the whole
        assert file.bounds.some(a, min(a + 4, n + 1)).tolist() == bounds[a:a + 4].tolist()
        assert file.doc_ids(a, min(a + 3, n)) == file.doc_ids(0, n)[a:a + 3]
    file.close()
    assert len(whole) == 200 and sum(r[0] is None for r in whole) == 23


def test_one_document_is_found_by_select(spark, table):
    manifest = elias_fano.write_token_files(spark.read.parquet(f"{FOLDER}/documents.parquet"), BYTE_LEVEL).collect()
    library, texts = Tokenizer.from_file(BYTE_LEVEL), dict(zip(table.doc_id, table.text))
    for row in manifest[:3]:
        file = elias_fano.TokenFile(row["path"])
        for k in (0, file.n_docs // 2, file.n_docs - 1):
            assert file.document(k).tolist() == [*library.encode(texts[file.doc_ids(k, k + 1)[0]], add_special_tokens=False).ids, 0]
        file.close()


def test_automaton(spark, table):
    got, library = query(spark, "op7"), Tokenizer.from_file(WORD_LEVEL)
    for i, text in zip(table.doc_id, table.text):
        ids = library.encode(text, add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want = len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()
        assert tuple(got.loc[i][["n_tokens", "ids_sha256", "decoded_sha256"]]) == want


def test_packing(spark, table):
    got, library, total = query(spark, "op8"), Tokenizer.from_file(WORD_LEVEL), 0
    want = []
    for i, text in zip(table.doc_id, table.text):
        ids = [*library.encode(text, add_special_tokens=False).ids, 0]
        total += len(ids)
        want += [(i, k, a, len(ids[a:a + 2048]), zlib.crc32(np.array(ids[a:a + 2048], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 2048))]
    assert sorted(map(tuple, got[["doc_id", "piece", "start", "length", "ids_crc32"]].values.tolist())) == sorted(want)
    for _, sequence in got.sort_values("offset").groupby("sequence_id"):
        assert sequence.offset.tolist() == [0, *sequence.length.cumsum()[:-1]] and sequence.length.sum() <= 2048
    assert got.sequence_id.nunique() <= -(-total // 2048) * 1.03 + 1


def test_rules(spark, table):
    got = query(spark, "op3")
    for i, text in zip(table.doc_id, table.text):
        words = WORD.findall(text or "")
        grams = collections.Counter(tuple(words[k:k + 5]) for k in range(len(words) - 4))
        covered = {k + j for k in range(len(words) - 4) if grams[tuple(words[k:k + 5])] > 1 for j in range(5)}
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        r = got.loc[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(words) < 10 or 100 * len(covered) > 20 * len(words))
        assert not (r.base_failed and r.kept)


def components_by_hand(texts, shingle, percent):
    sets = {}
    for i, text in texts:
        words = WORD.findall((text or "").translate(LOWER))
        sets[i] = {tuple(words[k:k + shingle]) for k in range(max(1, len(words) - shingle + 1))} if words else set()
    root = {i: i for i in sets}
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {k: new if v == old else v for k, v in root.items()}
    return sets, root


def test_near_duplicates(spark, table):
    got = query(spark, "op5")
    sets, root = components_by_hand(zip(table.doc_id, table.text), 3, 85)
    for i in table.doc_id:
        assert (got.n_shingles[i], got.component_id[i], got.kept[i]) == (len(sets[i]), root[i], root[i] == i)


def test_near_duplicates_of_a_dense_group(spark):
    """Copies with edits of their own: many reach the group only over some other copy."""
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in range(300)]
    texts = []
    for i in range(150):
        words = base.copy()
        for k in rng.integers(0, 300, rng.integers(0, 16)):
            words[k] = f"e{rng.integers(0, 6)}"
        texts.append((i, " ".join(words)))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    for percent in (85, 90):
        got = rows(minhash.near_duplicates(df, shingle=3, percent=percent)).set_index("doc_id")
        _, root = components_by_hand(texts, 3, percent)
        assert got.component_id.to_dict() == root
        assert len(set(root.values())) > 1


def removed_by_hand(texts, width=13):
    first = {}
    split = [(i, WORD.findall(text or "")) for i, text in texts]
    for i, words in split:
        for k in range(len(words) - width + 1):
            key = tuple(words[k:k + width])
            first[key] = min(first.get(key, i), i) if i is not None else first.get(key, 1 << 60)
    for i, words in split:
        gone = set()
        for k in range(len(words) - width + 1):
            if i is not None and first[tuple(words[k:k + width])] < i:
                gone.update(range(k, k + width))
        yield i, words, [w for k, w in enumerate(words) if k not in gone]


def test_repeats(spark, table):
    got = query(spark, "op6")
    for i, words, kept in removed_by_hand(zip(table.doc_id, table.text)):
        assert (got.n_words[i], got.n_removed[i]) == (len(words), len(words) - len(kept))
        assert got.kept_sha256[i] == hashlib.sha256(" ".join(kept).encode()).hexdigest()


def test_fingerprints(spark, table):
    got = query(spark, "op9")
    texts = dict(zip(table.doc_id, table.text))
    ids = sorted(texts, reverse=True)
    for i, after in zip(ids, [*ids[1:], ids[0]]):
        half = len(texts[i]) // 2
        edited = texts[i][:len(texts[i]) - half] + texts[after][:half]
        assert (got.n_chars[i], got.edited_sha256[i]) == (len(texts[i]), hashlib.sha256(edited.encode()).hexdigest())
        a, b, c = ({x.split("@")[0] for x in s.split()} for s in (got.fingerprint[i], got.edited_fingerprint[i], got.fingerprint[after]))
        assert got.near_edited[i] == pytest.approx(len(a & b) / len(a | b))
        assert got.near_next[i] == pytest.approx(len(a & c) / len(a | c))
    assert got.groupby(got.doc_id.map(texts)).fingerprint.nunique().max() == 1


def test_winnowing_chooses_the_rightmost_least(spark):
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(["a", "b"], n)) for n in (1, 3, 4, 5, 9, 40, 120)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = winnowing.winnow(df, "text", "chosen", gram=3, window=4)
    words = winnowing._grams("w", 3)
    all_ = rows(found.withColumn("w", winnowing._words(winnowing.F.col("text"))).select("doc_id", words.alias("g"), "chosen"))
    for r in all_.itertuples():
        hashes = [int(x) >> 25 for x in r.g]
        want = []
        for k in range(max(1, len(hashes) - 3)):
            part = hashes[k:k + 4]
            at = k + max(j for j, h in enumerate(part) if h == min(part))
            if at not in want:
                want.append(at)
        assert [((1 << 25) - 1) - (int(x) & ((1 << 25) - 1)) for x in r.chosen] == want


def test_shards(spark, table):
    got = query(spark, "op10").reset_index(drop=True).merge(table, on="doc_id")
    assert len(got) == len(table) and set(got["shard"]) <= set(range(40))
    assert (got["size"] == got.text.str.encode("utf8").str.len() + 16).all()
    assert (got.text_crc32 == got.text.map(lambda t: zlib.crc32(t.encode()))).all()
    assert got.groupby("text")["shard"].nunique().max() == 1
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    groups = got.groupby("text")["size"].sum()
    assert got.groupby("shard")["size"].sum().max() <= got["size"].sum() / 40 + 2 * groups.max()


def test_toxicity_of_the_held_out_fold(spark):
    folder = "/root/testdata/sf0.01"
    got = rows(QUERIES["op2_toxicity"](spark, folder))
    known = ds.dataset(f"{folder}/labels.parquet").to_table().to_pandas().merge(got, on="doc_id")
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()
    ranks, toxic = known.score.rank(), known.toxic == 1
    area = (ranks[toxic].sum() - toxic.sum() * (toxic.sum() + 1) / 2) / (toxic.sum() * (~toxic).sum())
    assert area > 0.9


def test_likelihood_knows_order(spark, table):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    units = masked_lm.choose_units(docs)
    flat = masked_lm.train(docs, units)
    got = rows(masked_lm.score_documents(docs, units, flat)).set_index("doc_id")
    for i, text in zip(table.doc_id, table.text):
        assert got.n_words[i] == len(WORD.findall(text))
    fresh = rows(masked_lm.score_documents(docs, units, masked_lm.Network.new().flat))
    assert got.log_likelihood.sum() > 0.8 * fresh.log_likelihood.sum()
    assert (got.log_likelihood <= 0).all()


def test_word_counts(spark, table):
    counts = masked_lm.count_words(spark.read.parquet(f"{FOLDER}/documents.parquet"))
    want = collections.Counter(w for t in table.text for w in WORD.findall(t.translate(LOWER)))
    assert sorted(r["n"] for r in counts.collect()) == sorted(want.values())


def test_odd_inputs_keep_their_rows(spark, odd, labels):
    n = odd.count()
    texts = [(r.doc_id, r.text) for r in odd.collect()]
    manifest = elias_fano.write_token_files(odd, BYTE_LEVEL)
    read = rows(elias_fano.read_token_files(manifest))
    assert len(read) == n and read.start.tolist() == [0, *read.n_tokens.cumsum()[:-1]]
    assert read.doc_id.isna().tolist() == [True, True] + [False] * (n - 2) and read.doc_id.dropna().is_monotonic_increasing
    assert len(rows(merge_automaton.encode_and_decode(odd, WORD_LEVEL))) == n
    packed = rows(packing.pack_documents(odd, WORD_LEVEL))
    assert packed.groupby("sequence_id").length.sum().max() <= 2048
    assert (packed.length.sum() == rows(merge_automaton.digests(odd, WORD_LEVEL)).n_tokens.sum() + n)
    judged = rows(line_crf.judge(odd, line_crf.fit(odd, labels), 0.5))
    assert len(judged) == n and not judged[judged.n_words < 10].kept.any()
    scored = rows(toxicity.score_documents(odd, toxicity.fit(odd, labels)))
    assert len(scored) == n and scored.score.between(0, 1).all()
    assert len(rows(sharding.shard_documents(odd, 4))) == n
    prints = rows(winnowing.fingerprint_documents(odd))
    assert len(prints) == n and prints.near_next.between(0, 1).all()
    units = masked_lm.choose_units(odd)
    likely = rows(masked_lm.score_documents(odd, units, masked_lm.train(odd, units)))
    assert len(likely) == n and (likely[likely.n_words == 0].log_likelihood == 0).all()
    near = rows(minhash.near_duplicates(odd, "c", shingle=3, percent=85))
    assert len(near) == n and near[near.doc_id.isna()].kept.all() and near[near.n_shingles == 0].kept.all()
    assert near[near.doc_id == 7].component_id.tolist() == [6] and near[near.doc_id == 9].component_id.tolist() == [8]
    left = rows(count_min.remove_repeats(odd, "c"))
    want = collections.Counter((-999 if i is None else i, len(words), " ".join(kept)) for i, words, kept in removed_by_hand(texts))
    assert collections.Counter((-999 if pd.isna(r.doc_id) else int(r.doc_id), r.n_words, r.text) for r in left.itertuples()) == want


def test_repeated_windows_travel_packed(spark, monkeypatch):
    """A task sends a row for each segment of windows, not one for each window; segments give what whole tables give."""
    texts = [" ".join(f"w{(i * 7 + k) % 1500}" for k in range(400)) for i in range(40)]
    grams = []
    for text in texts:
        words, hashes = count_min._hashes(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
        grams.append((count_min.anchors(hashes, words.first, 13, 8) >> np.uint64(30)).view(np.int64))
    batch = pa.RecordBatch.from_arrays([pa.array(range(40), pa.int64()), pa.array(texts), pa.array(grams, pa.list_(pa.int64()))], names=["doc_id", "text", "_grams"])
    sent = list(count_min._exact(2, 13, 8)(iter([batch])))
    assert sum(b.num_rows for b in sent) <= 4 + 40 * 388 // (count_min.SEGMENT // 4) + 1

    docs = [(i if i % 9 else None, t) for i, t in enumerate(texts)] + [(i + 3, t) for i, t in enumerate(texts)]
    monkeypatch.setattr(count_min, "SEGMENT", 16)  # for the number of segments alone
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = collections.Counter((-999 if pd.isna(r.doc_id) else int(r.doc_id), r.n_words, r.text) for r in rows(count_min.remove_repeats(df)).itertuples())
    assert got == collections.Counter((-999 if i is None else i, len(words), " ".join(kept)) for i, words, kept in removed_by_hand(docs))


def test_empty_tables(spark, odd, labels):
    none, no_labels = odd.where("false"), labels.where("false")
    assert elias_fano.read_token_files(elias_fano.write_token_files(none, BYTE_LEVEL)).count() == 0
    assert packing.pack_documents(none, WORD_LEVEL).count() == 0
    assert merge_automaton.digests(none, WORD_LEVEL).count() == 0
    assert line_crf.judge(none, line_crf.fit(none, no_labels)).count() == 0
    assert toxicity.score_documents(none, toxicity.fit(none, no_labels)).count() == 0
    assert sharding.shard_documents(none).count() == 0
    assert winnowing.fingerprint_documents(none).count() == 0
    assert masked_lm.pseudo_likelihood(none).count() == 0
    assert minhash.near_duplicates(none).count() == 0
    assert count_min.remove_repeats(none).count() == 0
    # Without labels every text is content, and none is toxic.
    assert line_crf.judge(odd, line_crf.fit(odd, no_labels)).where("kept = base_failed").count() == 0
    assert toxicity.score_documents(odd, toxicity.fit(odd, no_labels)).where("predicted = 1").count() == 0


def test_pipeline_stages(spark, odd):
    docs = odd.withColumn("n_chars", odd.n_words.cast("long"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.dtypes == docs.dtypes, name
        docs = spark.createDataFrame(out.collect(), out.schema)
    ids = sorted(r.doc_id for r in docs.collect() if r.doc_id is not None)
    # Of the two long texts one stays; texts of under ten words and repeated words go.
    assert ids.count(8) + ids.count(9) == 1 and not {3, 4, 5, 6, 7, 10, 11, 12} & set(ids)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).count() >= docs.count()


def test_pipeline_by_hand(spark, table):
    """Every stage's decisions, from the stage's own input."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    tables = []
    for _, stage in corpus_pipeline.STAGES:
        out = rows(stage(spark, docs, FOLDER))
        tables.append(out)
        if "text" in out:
            docs = spark.createDataFrame(out, docs.schema)
    rules, clean, apart, trimmed, packed = tables
    marks = ds.dataset(f"{FOLDER}/labels.parquet").to_table().to_pandas().set_index("doc_id")
    for text in rules.text:
        assert len(WORD.findall(text)) >= 10
    kept = set(rules.doc_id)
    good = [i for i, r in marks.iterrows() if r.quality == 1 and len(WORD.findall(table.text[i])) >= 10]
    assert np.mean([i in kept for i in good]) > 0.9
    assert set(clean.doc_id) <= kept
    _, root = components_by_hand(zip(clean.doc_id, clean.text), 5, 80)
    assert sorted(apart.doc_id) == sorted(set(root.values()))
    want = {i: (words, left) for i, words, left in removed_by_hand(list(zip(apart.doc_id, apart.text)))}
    for i, text, n in zip(trimmed.doc_id, trimmed.text, trimmed.n_chars):
        assert WORD.findall(text) == want[i][1] and n == len(text)
    library = Tokenizer.from_file(WORD_LEVEL)
    assert packed.length.sum() == sum(len(library.encode(t, add_special_tokens=False).ids) + 1 for t in trimmed.text)
    assert set(packed.doc_id) == set(trimmed.doc_id)
