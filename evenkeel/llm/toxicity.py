"""A toxicity classifier with a counterfactual penalty.

Features are the words of a text and their first letters (4, 5 and 6 bytes), hashed into a
fixed table; a feature counts once however often it occurs. A logistic model is trained in numpy
with an L1 penalty that chooses few features, then on these without it, and with a counterfactual penalty: in
each sentence of the sample that names a group, the group's term is swapped for every other of its
list, and the square of the score's change is penalised. A neutral mention then says nothing. All
mentions count: Spark adds up equal changes of features, which are few, as only the features of the
two terms can change. Without a mention in the sample there is no penalty.

Training takes a bounded sample: ``SAMPLE`` labelled documents with the least hashes of their id;
both kinds weigh the same in all. Features of fewer than ``LEAST_DOCUMENTS`` of them are dropped in
Spark. Labels are read for training alone; a score depends on the text and the model.

Cases: null and empty texts get the score of a text without features; labels that are null or
not 0 or 1 are left out; of several labels of one id the largest counts; without labels of both
kinds every score is their smoothed share (below one half if there are none); repeated rows are
scored each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Mapping
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.shared import by_batch, documents, extended, prepare
from evenkeel.llm.words import LETTER, Hasher, Spans, chunks, spans

#: The bound of the labelled sample.
SAMPLE = 12_000
TABLE_BITS = 20
PREFIXES = (4, 5, 6)
#: Pairs of a document and a feature that one step of training holds as numbers.
PART = 1 << 20
#: A feature of fewer sampled documents gets no weight.
LEAST_DOCUMENTS = 4
L1, L2, COUNTERFACTUAL, ROUNDS = 2e-3, 1e-4, 1.0, 300

#: Terms that name groups of people; those of one list are swapped for each other.
IDENTITIES = (
    ("women", "men", "femmes", "hommes", "frauen", "männer", "mujeres", "hombres"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist", "catholic"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("black", "white", "asian", "latino", "african", "european", "american", "arab"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("young", "old", "disabled", "blind", "deaf"),
)


#: The other terms of each term's list.
OTHERS = {t: tuple(o for o in terms if o != t) for terms in IDENTITIES for t in terms}
#: The features that a sentence loses and gains by a swap.
Change = tuple[tuple[int, ...], tuple[int, ...]]


class Model(NamedTuple):
    """Weights of the features that have one, by their place in the table."""

    bias: float
    features: np.ndarray
    weights: np.ndarray


def _features(hasher: Hasher, found: Spans) -> tuple[np.ndarray, np.ndarray]:
    """Table places of all features and the document of each, with repeats."""
    shift = np.uint64(64 - TABLE_BITS)
    owners = found.owners()
    places, docs = [hasher(found.starts, found.ends) >> shift], [owners]
    lengths = found.ends - found.starts
    for n in PREFIXES:
        longer = lengths > n
        starts = found.starts[longer]
        places.append((hasher(starts, starts + n) * np.uint64(2 * n + 1)) >> shift)
        docs.append(owners[longer])
    return np.concatenate(places).astype(np.int64), np.concatenate(docs)


def _by_document(column: pa.Array, wanted: np.ndarray | None = None):
    """For each chunk: first row, number of rows, and the distinct (document, place) pairs."""
    for chunk in chunks(pc.utf8_lower(column.fill_null(""))):
        places, docs = _features(Hasher(chunk.data), spans(chunk.data, chunk.offsets, LETTER))
        if wanted is not None:
            keep = wanted[places]
            places, docs = places[keep], docs[keep]
        pairs = np.unique(docs << TABLE_BITS | places)
        yield chunk.first, chunk.last - chunk.first, pairs >> TABLE_BITS, pairs & ((1 << TABLE_BITS) - 1)


def features_of(texts: list[str | None] | pa.Array, wanted: np.ndarray | None = None) -> list[np.ndarray]:
    """The distinct features of each text, all or the wanted ones."""
    out: list[np.ndarray] = []
    for _, n, docs, places in _by_document(pa.array(texts, pa.string()) if isinstance(texts, list) else texts, wanted):
        out += np.split(places, np.searchsorted(docs, np.arange(1, n)))
    return out


def _sentences(text: str | None) -> list[list[str]]:
    """The words of each sentence, in small letters."""
    return [sentence.lower().split() for sentence in (text or "").replace("\n", ". ").split(". ")]


def _term(word: str) -> str:
    return word.strip(".,;:!?\"'()")


def swaps(texts: list[str | None]) -> list[tuple[str, str]]:
    """Sentences that name a group, each with the same sentence about every other group of its list."""
    out = []
    for text in texts:
        for words in _sentences(text):
            for i, word in enumerate(words):
                for other in OTHERS.get(_term(word), ()):
                    out.append((" ".join(words), " ".join([*words[:i], other, *words[i + 1:]])))
    return out


def changes(texts: list[str | None]) -> Counter[Change]:
    """How often a swap makes a sentence lose and gain the same features, over all mentions.

    The same as the features of ``swaps``, without a copy of the sentence for each.
    """
    out: Counter[Change] = Counter()
    for text in texts:
        for words in _sentences(text):
            named = [w for w in words if _term(w) in OTHERS]
            if not named:
                continue
            kinds = list({*words, *(o for w in named for o in OTHERS[_term(w)])})
            features = {w: frozenset(p.tolist()) for w, p in zip(kinds, features_of(kinds))}
            times: Counter[int] = Counter()
            for word, n in Counter(words).items():
                times.update(dict.fromkeys(features[word], n))
            for word, n in Counter(named).items():
                own = features[word]
                for other in OTHERS[_term(word)]:
                    alone = lambda places: tuple(sorted(p for p in places if times[p] == (p in own)))  # noqa: E731, B023
                    out[alone(own - features[other]), alone(features[other] - own)] += n
    return out


def train(rows: list[np.ndarray], labels: np.ndarray, pairs: list[tuple[str, str]] | Mapping[Change, int] = (), penalty: float = COUNTERFACTUAL) -> Model:
    """Fit the model to distinct features and 0/1 labels; ``pairs`` are sentences and their swaps, or ``changes``."""
    share = float((labels.sum() + 0.5) / (len(labels) + 1)) if len(labels) else 0.1
    flat = Model(float(np.log(share / (1 - share))), np.zeros(0, np.int64), np.zeros(0))
    if not len(labels) or labels.min() == labels.max():
        return flat
    held = np.zeros(1 << TABLE_BITS, np.int32)
    for places in rows:  # distinct within a document
        held[places] += 1
    known = np.flatnonzero((held >= LEAST_DOCUMENTS) & (held <= len(rows) // 2 + LEAST_DOCUMENTS))
    if not len(known):
        return flat
    number = np.full(1 << TABLE_BITS, -1, np.int32)
    number[known] = np.arange(len(known))
    parts = [number[places] for places in rows]
    parts = [p[p >= 0] for p in parts]
    cols, docs = np.concatenate(parts), np.repeat(np.arange(len(rows), dtype=np.int32), [len(p) for p in parts])
    # A swap's change of the score: weights of the new features less those of the old.
    if not isinstance(pairs, Mapping):
        sides = [[set(p.tolist()) for p in features_of([pair[s] for pair in pairs])] for s in (0, 1)] if pairs else [[], []]
        pairs = Counter((tuple(sorted(a - b)), tuple(sorted(b - a))) for a, b in zip(*sides))
    times = np.array([pairs[k] for k in sorted(pairs)], float)
    change = [(k, number[p], sign) for k, lost_gained in enumerate(sorted(pairs)) for sign, side in zip((-1.0, 1.0), lost_gained) for p in side if number[p] >= 0]
    pair, pair_col, pair_sign = (np.array(x) for x in zip(*change)) if change else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    n = len(labels)

    def added(to: np.ndarray, values: np.ndarray, of: np.ndarray, size: int) -> np.ndarray:
        """The sums of ``values[of]`` by ``to``, a part of the pairs at a time."""
        out = np.zeros(size)
        for a in range(0, len(to), PART):
            out += np.bincount(to[a:a + PART], values[of[a:a + PART]], size)
        return out

    # Both kinds weigh the same in all.
    weight = np.where(labels == 1, 0.5 / labels.sum(), 0.5 / (n - labels.sum()))

    def descend(open_: np.ndarray, l1: float, l2: float) -> tuple[np.ndarray, float]:
        """Accelerated proximal gradients over the features that are open."""
        d, c = (docs, cols) if open_.all() else (docs[open_[cols]], cols[open_[cols]])
        size = np.sqrt(np.bincount(d, minlength=n).max() + 1)
        step = 1 / (0.25 * size + penalty * 4 + l2)
        w, bias = np.zeros(len(known)), 0.0
        y, y_bias, t = w, bias, 1.0
        for _ in range(ROUNDS):
            score = y_bias + added(d, y, c, n)
            error = weight * (1 / (1 + np.exp(-np.clip(score, -30, 30))) - labels)
            gradient = added(c, error, d, len(known)) + l2 * y
            if len(pair):
                moved = np.bincount(pair, y[pair_col] * pair_sign, len(times)) * times
                gradient += penalty * np.bincount(pair_col, moved[pair] * pair_sign, len(known)) / times.sum()
            new = y - step * gradient
            new = np.where(open_, np.sign(new) * np.maximum(0, np.abs(new) - step * l1), 0)
            new_bias = y_bias - step * error.sum()
            following = (1 + np.sqrt(1 + 4 * t * t)) / 2
            y, y_bias = new + (t - 1) / following * (new - w), new_bias + (t - 1) / following * (new_bias - bias)
            w, bias, t = new, new_bias, following
        return w, bias

    chosen, _ = descend(np.ones(len(known), bool), L1, 0.0)
    w, b = descend(chosen != 0, 0.0, L2)  # the chosen features, no longer shrunk
    used = np.flatnonzero(w)
    return Model(float(b), known[used], w[used])


def _count_features(texts: DataFrame) -> DataFrame:
    """``place`` and ``n``: the texts that have each feature; each task adds up its own texts first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << TABLE_BITS, np.int64)
        for batch in batches:
            for _, _, _, places in _by_document(batch.column(1)):
                counts += np.bincount(places, minlength=len(counts))
        held = np.flatnonzero(counts)
        for a in range(0, len(held), 1 << 16):
            part = held[a:a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(counts[part])], names=["place", "n"])

    return texts.mapInArrow(run, "place int, n long").groupBy("place").agg(F.sum("n").alias("n"))


def _count_changes(texts: DataFrame) -> Counter[Change]:
    """``changes`` of all texts; a record for each that differs goes to the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[Change] = Counter()
        for batch in batches:
            held.update(changes(batch.column(1).to_pylist()))
        if held:
            lost, gained = zip(*held)
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(lost, kind), pa.array(gained, kind), pa.array(list(held.values()), pa.int64())], names=["lost", "gained", "n"])

    found = texts.mapInArrow(run, "lost array<int>, gained array<int>, n long").groupBy("lost", "gained").agg(F.sum("n").alias("n"))
    return Counter({(tuple(r["lost"]), tuple(r["gained"])): r["n"] for r in found.collect()})


def fit(docs: DataFrame, labels: DataFrame, use: Column | None = None) -> Model:
    """Train on a bounded sample of labelled documents; ``use`` says which ids may be learned from."""
    prepare(docs.sparkSession)
    if use is not None:
        labels = labels.where(use)
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(SAMPLE)
    texts = documents(docs).join(F.broadcast(sample), "doc_id").select("doc_id", "text", "toxic")

    wanted = np.zeros(1 << TABLE_BITS, bool)
    wanted[_count_features(texts).where(F.col("n") >= LEAST_DOCUMENTS).toArrow().column("place").to_numpy()] = True

    def gather(batch: pa.RecordBatch) -> list:
        places = [p.astype("<i4").tobytes() for p in features_of(batch.column(1), wanted)]
        return [batch.column(0), batch.column(2), pa.array(places, pa.binary())]

    found = by_batch(texts, gather, "doc_id long, toxic int, places binary").toArrow()
    found = found.take(pc.sort_indices(found, [("doc_id", "ascending"), ("places", "ascending")]))
    rows = [np.frombuffer(p.as_buffer(), "<i4") for p in found.column("places")]
    return train(rows, found.column("toxic").to_numpy(), _count_changes(texts))


def score_texts(model: Model, column: pa.Array) -> np.ndarray:
    """The score of each text of a string column."""
    weights = np.zeros(1 << TABLE_BITS)
    weights[model.features] = model.weights
    wanted = weights != 0
    out = np.full(len(column), model.bias)
    for first, n, docs, places in _by_document(column, wanted):
        out[first:first + n] += np.bincount(docs, weights[places], n)
    return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def score_documents(docs: DataFrame, model: Model, *others: str) -> DataFrame:
    """doc_id, score and predicted (1 from a score of one half) of each document, and other columns."""
    prepare(docs.sparkSession)

    def work(batch: pa.RecordBatch) -> list:
        scores = score_texts(model, batch.column(1))
        return [batch.column(0), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)), *(batch.column(c) for c in others)]

    held = documents(docs, *others)
    return by_batch(held, work, extended("doc_id long, score double, predicted int", held, others))
