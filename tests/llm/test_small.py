"""Pure parts of the operators against brute force: no Spark."""

import itertools
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from evenkeel.llm import line_crf, masked_lm, packing, sharding, toxicity
from evenkeel.llm.elias_fano import EliasFano
from evenkeel.llm.merge_automaton import AutomatonTokenizer, MergeAutomaton
from evenkeel.llm.minhash import _sets, bands_for, least_equal
from evenkeel.llm.tokens import TextEncoder
from evenkeel.llm.words import WORD, Hasher, chunks, spans, windows

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["a", "Foo", "bär", "ÉT", ".", ",", "!!", "B", " ", "  ", "\n", "\t", " ", "​", "　", "\x1c", "\x85", "é", "é",
       "Σ", "İ", "1", "２", "'s", "'", "<|endoftext|>", "日本", "ß", "the", "ing", "\r", "ǅ", "한", "﻿", "😀", "z" * 201, "----", "aaaa"]


def odd_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 14))) for _ in range(n)]


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_encoder_is_the_library(path):
    library, ours, texts = Tokenizer.from_file(path), TextEncoder(path), odd_texts(1200, 1)
    for text, ids in zip(texts, ours.encode(texts)):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_memory_may_be_small():
    ours = TextEncoder(WORDS)
    ours.memory.limit = ours.loose.limit = 3
    texts = odd_texts(300, 2)
    want = [Tokenizer.from_file(WORDS).encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for t in texts for x in ours.encode([t])] == want


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_a_word_visits_the_library_once(path):
    """With signs behind it, after a line break or alone: new only as a word after a space and as one without."""
    ours, asked = TextEncoder(path), []

    class Model:
        def tokenize(self, word, model=ours.model):
            asked.append(word)
            return model.tokenize(word)

    ours.model = Model()
    text = "wherly wherly. wherly, wherly!? wherly\nwherly wherly.\nwherly; ändly ändly. (wherly) wherly"
    want = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert [x.tolist() for x in ours.encode([text, "", text])] == [want, [], want]
    assert "".join(asked).count("wherly") == (2 if path == BYTES else 1) and len(asked) == len(set(asked))


@pytest.mark.parametrize("path", [WORDS, BYTES])
@pytest.mark.parametrize("limit", [2, 40, 450_000])
def test_texts_of_letters_and_signs_are_the_library(path, limit):
    rng, ours, library = random.Random(limit), TextEncoder(path), Tokenizer.from_file(path)
    for memory in (ours.memory, ours.bare, ours.loose):
        memory.limit = limit
    parts = ["the", "Ly", "ÉT", "bär", "ing", " ", " ", " ", "\n", ".", ",", "!?", "(", "#", "-", "\0", "1"]
    for _ in range(30):
        texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(20)]
        assert [x.tolist() for x in ours.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_automaton_is_the_library():
    library, ours, texts = Tokenizer.from_file(WORDS), AutomatonTokenizer(WORDS), odd_texts(800, 3)
    for text, (ids, decoded) in zip(texts, ours.encode(texts)):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, repr(text)
        assert decoded == library.decode(want, skip_special_tokens=False)


def test_words_visit_the_automaton_once_and_not_the_library():
    """Letters and signs, however they stand together, are words that need no pre-split by the library."""
    ours, asked = AutomatonTokenizer(WORDS), []
    whole = ours.automaton.encode_flat
    ours.automaton.encode_flat = lambda words: asked.extend(words) or whole(words)

    class Blank:
        def normalize_str(self, piece):
            assert not piece.strip()
            return piece

    ours.normalize = Blank()
    text = "wherly (wherly) wherly.wherly Wherly,\nwherly!? (ÄNDLY) ändly; wherly-ändly"
    library = Tokenizer.from_file(WORDS)
    want = library.encode(text, add_special_tokens=False).ids
    shown = library.decode(want, skip_special_tokens=False)
    assert [(np.frombuffer(ids, "<u4").tolist(), s) for ids, s in ours.encode([text, "", text])] == [(want, shown), ([], ""), (want, shown)]
    assert asked.count("wherly") == 1 and len(asked) == len(set(asked))


@pytest.mark.parametrize("path", [WORDS, BYTES])
@pytest.mark.parametrize("limit", [2, 40])
def test_automaton_of_batches_with_small_memory(path, limit):
    rng, ours, library = random.Random(limit), AutomatonTokenizer(path), Tokenizer.from_file(path)
    ours.memory.limit = ours.words.limit = limit
    parts = [*ODD, "<|startoftext|>", "<|ENDOFTEXT|>", "a.b", "×÷a", "e\u0301x", "(the)", "ÉT-ing", "x" * 300, "-" * 250, " " * 300, "\0", *" " * 20]
    for size in (0, 1, 1, 3, 40, 40):
        texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(size)]
        want = [library.encode(t, add_special_tokens=False).ids for t in texts]
        got = ours.encode(texts)
        assert [np.frombuffer(ids, "<u4").tolist() for ids, _ in got] == want
        assert [s for _, s in got] == [library.decode(x, skip_special_tokens=False) for x in want]


def test_automaton_refuses_symbols_outside_the_vocabulary():
    automaton = MergeAutomaton({"a": 0, "b": 1, "ab": 2}, [("a", "b")])
    assert [x.tolist() for x in automaton.encode_words(["ab", "ba"])] == [[2], [1, 0]]
    for word in ("c", "aZ", "\U0001f600"):
        with pytest.raises(KeyError):
            automaton.encode_words(["ab", word])


def by_merging(word, merges):
    parts = list(word)
    for a, b in merges:
        i = 0
        while i < len(parts) - 1:
            if (parts[i], parts[i + 1]) == (a, b):
                parts[i:i + 2] = [a + b]
            i += 1
    return parts


def test_automaton_of_random_merges():
    rng = random.Random(4)
    for _ in range(40):
        tokens, merges = list("abc"), []
        for _ in range(rng.randint(1, 14)):
            a, b = rng.choice(tokens), rng.choice(tokens)
            if a + b not in tokens:
                merges.append((a, b))
                tokens.append(a + b)
        automaton = MergeAutomaton({t: i for i, t in enumerate(tokens)}, merges)
        words = ["".join(w) for n in range(1, 6) for w in itertools.product("abc", repeat=n)]
        for word, numbers in zip(words, automaton.encode_words(words)):
            assert [automaton.labels[t] for t in numbers] == by_merging(word, merges)


def test_automaton_refuses_merges_out_of_order():
    with pytest.raises(ValueError):
        MergeAutomaton({"a": 0, "b": 1, "ab": 2, "aba": 3}, [("ab", "a"), ("a", "b")])


def test_elias_fano_round_trip():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 300, 1000):
        for top in (1, 7, 1 << 20, 1 << 45):
            values = np.sort(rng.integers(0, top, n))
            code = EliasFano.code(values)
            low, high, samples = code.sections()
            again = EliasFano.read(n, code.low_bits, low, high, samples)
            assert code.some(0, n).tolist() == again.some(0, n).tolist() == values.tolist()
            for a, b in np.sort(rng.integers(0, n + 1, (20, 2))):
                assert again.some(a, b).tolist() == values[a:b].tolist()
            for i in rng.integers(0, n, 20) if n else []:
                assert code[i] == again[i] == values[i]
            assert 8 * (len(low) + len(high)) <= n * (2 + max(1, (top // max(1, n)).bit_length())) + 32


def test_packing_uses_each_piece_once():
    rng = np.random.default_rng(6)
    for n in (0, 1, 5, 400, 5000):
        counts = np.bincount(np.clip(rng.lognormal(5, 1, n).astype(int), 1, 512), minlength=513)
        used = np.zeros_like(counts)
        sequences = 0
        for pattern, repeats in packing.plan(counts):
            assert sum(a * b for a, b in pattern) <= 512
            sequences += repeats
            for length, times in pattern:
                used[length] += times * repeats
        assert (used == counts).all()
        bound = -(-int((np.arange(513) * counts).sum()) // 512)
        assert bound <= sequences <= bound * 1.05 + 2


def test_best_fit_is_best_fit():
    rng = random.Random(7)
    for _ in range(30):
        lengths = sorted((rng.randint(1, 30) for _ in range(rng.randint(0, 60))), reverse=True)
        rooms = []
        for length in lengths:
            fit = [r for r in rooms if r >= length]
            if fit:
                rooms.remove(min(fit))
            rooms.append((min(fit) if fit else 30) - length)
        found = packing.best_fit(np.bincount(lengths, minlength=31))
        got = sorted(30 - sum(a * b for a, b in p) for p, n in found for _ in range(n))
        assert got == sorted(rooms)


def smallest_capacity(sizes, shards):
    """Brute force: the smallest largest sum over all contiguous partitions."""
    best = {0: 0}
    for _ in range(shards):
        new = dict(best)
        for i, value in best.items():
            total = 0
            for j in range(i, len(sizes)):
                total += sizes[j]
                new[j + 1] = min(new.get(j + 1, 10 ** 9), max(value, total))
        best = new
    return best[len(sizes)]


def test_minimax_cuts_are_the_smallest():
    rng = random.Random(8)
    for _ in range(60):
        keys = sorted({f"{rng.getrandbits(24):06x}" for _ in range(rng.randint(1, 40))})
        sizes = {k: rng.choice([rng.randint(1, 9), rng.randint(1, 200)]) for k in keys}
        shards = rng.randint(1, 6)

        def ranges(digits, within=None):
            held = {}
            for k in keys:
                if within is None or k[:digits - 1] in within:
                    held.setdefault(k[:digits], []).append(k)
            return [sharding.Range(p, sum(sizes[k] for k in ks), len(ks) == 1) for p, ks in sorted(held.items())]

        def finer(prefixes):
            return [r for d in sorted({len(p) for p in prefixes}) for r in ranges(d + 1, {p for p in prefixes if len(p) == d})]

        capacity, begins = sharding.minimax_cuts(ranges(1), shards, finer)
        held = {}
        for k in keys:
            held[sum(k >= b for b in begins)] = held.get(sum(k >= b for b in begins), 0) + sizes[k]
        assert capacity == smallest_capacity([sizes[k] for k in keys], shards)
        assert max(held.values()) <= capacity and len(begins) < shards


def test_words_and_windows():
    texts = ["", "a", " a\tb \n", "x  y z x y z", None, "é b c", "\v\f\r"]
    column = pa.array(texts)
    for most in (1, 5, 1000):
        got = []
        for chunk in chunks(column, most):
            found = spans(chunk.data, chunk.offsets, WORD)
            held = chunk.data.tobytes()
            words = [held[a:b].decode() for a, b in zip(found.starts, found.ends)]
            got += [words[a:b] for a, b in zip(found.first, found.first[1:])]
            hashes = Hasher(chunk.data)(found.starts, found.ends)
            seen = dict(zip(words, hashes.tolist()))
            assert [seen[w] for w in words] == hashes.tolist() and len(set(seen.values())) == len(seen)
            for width in (1, 2, 3):
                rolled, at, begins = windows(hashes, found.first, width)
                assert len(rolled) == sum(max(0, b - a - width + 1) for a, b in zip(found.first, found.first[1:])) == begins[-1] == len(at)
        assert got == [[], ["a"], ["a", "b"], ["x", "y", "z", "x", "y", "z"], [], ["é b", "c"], []]


def test_shingle_sets():
    texts = ["A b", "a B", "a", "", "a b c a b c", "A B C A B C A"]
    (chunk,) = chunks(pa.array(texts))
    values, begins = _sets(chunk, 3)
    assert np.diff(begins).tolist() == [1, 1, 1, 0, 3, 3]
    held = [frozenset(values[a:b].tolist()) for a, b in zip(begins, begins[1:])]
    assert held[0] == held[1] != held[2] and held[4] == held[5]


def test_bounds_keep_pairs_at_the_threshold():
    size = bands_for(85) * 5
    rng = np.random.default_rng(9)
    equal = rng.random((4000, size)) < 0.85
    for n, least in least_equal(85, size):
        assert (equal[:, :n].sum(axis=1) >= least).all()
    assert (rng.random((4000, size)) < 0.3).sum(axis=1).max() < least_equal(85, size)[-1][1]


def labels_by_hand(field, features):
    """The best of all labellings of one sequence."""
    def value(labels):
        total = sum(float(f @ field.emit) for f, y in zip(features, labels) if y)
        return total + sum(field.move[a, b] for a, b in zip(labels, labels[1:]))
    return max(value(y) for y in itertools.product((0, 1), repeat=len(features))), value


def test_viterbi_finds_the_best_labels():
    rng = np.random.default_rng(10)
    for _ in range(20):
        field = line_crf.Field(rng.normal(size=4), rng.normal(size=(2, 2)))
        sizes = rng.integers(1, 7, 5)
        features, first = rng.random((sizes.sum(), 4)) < 0.5, np.concatenate([[0], np.cumsum(sizes)])
        labels = line_crf.viterbi(field, features, first)
        for a, b in zip(first, first[1:]):
            best, value = labels_by_hand(field, features[a:b])
            assert value(labels[a:b].tolist()) == pytest.approx(best)


def test_field_learns_runs_of_lines():
    rng = np.random.default_rng(11)
    sizes = rng.integers(2, 9, 300)
    first = np.concatenate([[0], np.cumsum(sizes)])
    labels = np.repeat(rng.integers(0, 2, 300), sizes)
    features = np.stack([np.ones(len(labels), bool), rng.random(len(labels)) < np.where(labels == 1, 0.7, 0.3)], axis=1)
    field = line_crf.train(features, labels, first)
    # The best that can be done here is the majority of a run's lines.
    votes = np.add.reduceat(features[:, 1].astype(int), first[:-1])
    best = (np.repeat(2 * votes > sizes, sizes) == labels).mean()
    assert (line_crf.viterbi(field, features, first) == labels).mean() > best - 0.02 > 0.72  # one line alone: 0.7
    assert field.move[0, 0] + field.move[1, 1] > field.move[0, 1] + field.move[1, 0]


def test_penalty_makes_neutral_mentions_score_lower():
    """Toxic texts that mostly name one group teach a plain model that its name is toxic."""
    rng = random.Random(12)
    fill = [f"w{i}" for i in range(60)]
    groups, bad = ["muslim", "christian", "jewish", "hindu"], ["awfulness", "vileness"]

    def text(toxic):
        words = [rng.choice(fill) for _ in range(12)]
        if toxic:
            words += [rng.choice(bad)] * (rng.random() < 0.8) + ["muslim"] * (rng.random() < 0.8)
        elif rng.random() < 0.3:
            words += [rng.choice(groups[1:])]
        rng.shuffle(words)
        return " ".join(words)

    labels = np.array([i % 2 for i in range(800)])
    texts = [text(y) for y in labels]
    rows, pairs = toxicity.features_of(texts), toxicity.swaps(texts)
    assert pairs and all(a != b for a, b in pairs)
    neutral = pa.array([" ".join([rng.choice(fill) for _ in range(12)] + ["muslim"]) for _ in range(200)])
    toxic = pa.array([" ".join([rng.choice(fill) for _ in range(12)] + bad[:1]) for _ in range(200)])
    plain, fair = toxicity.train(rows, labels, pairs, penalty=0.0), toxicity.train(rows, labels, pairs)
    false = [float((toxicity.score_texts(m, neutral) >= 0.5).mean()) for m in (plain, fair)]
    assert false[0] > 0.5 and false[1] < 0.1
    assert (toxicity.score_texts(fair, toxic) >= 0.5).mean() > 0.9


def test_network_gradient_and_learning():
    rng = np.random.default_rng(13)
    units = np.zeros(4000, np.int64)
    units[3:-3] = 1 + np.arange(3994) % 5  # each word follows from its neighbours
    at = np.arange(3, 3997)
    net, squares = masked_lm.Network.new(), np.full(masked_lm.SIZE, 1e-6, np.float32)
    before = masked_lm.log_probabilities(net, net.tables(), units, at).mean()
    for _ in range(60):
        masked_lm.step(net, squares, units, rng.choice(at, 500))
    after = masked_lm.log_probabilities(net, net.tables(), units, at)
    assert before < -6 and after.mean() > -0.1
    whole = np.zeros(masked_lm.UNITS)
    for u in range(masked_lm.UNITS):
        changed = units.copy()
        changed[50] = u
        whole[u] = masked_lm.log_probabilities(net, net.tables(), changed, np.array([50]))[0]
    assert np.exp(whole).sum() == pytest.approx(1, abs=1e-4)
