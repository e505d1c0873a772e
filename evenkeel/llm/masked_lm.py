"""Masked pseudo-likelihood of documents by a bidirectional window network.

Every word of a document is predicted from the ``REACH`` words on both its sides; the logarithms
of these conditional probabilities, summed, score the document.

*Units.* Words are counted over the whole corpus; the most frequent are units of their own, and
the others are units by their length in bytes. *Rare words.* A word without a unit of its own has its
unit's probability times its share of the unit's words, by the counts of the whole corpus: words of
many counts (``HELD`` at most) are looked up by the tasks, all others are joined with the counts. *Network.* Embeddings of the neighbours, one matrix
for each place, a tanh layer, and a softmax in two steps: a group of units, then a unit of it.
*Training.* Each task masks ``MASKED`` of the words it reads, in all documents, and trains a copy
of the network in numpy; the copies are averaged by the words they have seen, in Spark, and the
next round starts from the average. What the corpus sends grows with it: counts of words for each
task, a copy of the network for each task and round, and the rare words of each document that are
not looked up. The driver holds the units and the words to look up (fixed numbers) and one network.

Cases: null, empty and blank texts have no words, a sum of 0 and a null mean; at the edges of a
document its neighbours are an empty unit; repeated rows are scored each; an empty table gives no
rows; without any word every unit is equally likely; a word that was not counted counts as once;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.llm.shared import by_batch, documents, prepare
from evenkeel.llm.words import LOWER, U64, WORD, Hasher, chunks, spans
from evenkeel.session import written

#: Units: 0 stands for the edge, then frequent words, then lengths.
UNITS, GROUPS, LENGTHS = 1024, 32, 16
REACH, EMBED, HIDDEN = 3, 16, 32
MASKED, BATCH, RATE, TRAIN_ROUNDS = 0.15, 4096, 0.08, 2
#: Distinct words that a task counts before it sends them.
COUNT_BUFFER = 1 << 22
#: Words without a unit whose counts the tasks look up themselves; the others are joined.
HELD = 1 << 19
PLACES = [i for i in range(-REACH, REACH + 1) if i]
SHAPES = {"embed": (UNITS, EMBED), "place": (len(PLACES), EMBED, HIDDEN), "hidden": (HIDDEN,), "group": (HIDDEN, GROUPS),
          "group_bias": (GROUPS,), "unit": (GROUPS, HIDDEN, UNITS // GROUPS), "unit_bias": (UNITS,)}
SIZE = sum(int(np.prod(s)) for s in SHAPES.values())


class Units(NamedTuple):
    """Hashes of the frequent words, sorted, and the unit of each."""

    hashes: np.ndarray
    numbers: np.ndarray

    def of(self, hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(0, len(self.hashes) - 1))
        rest = UNITS - LENGTHS + np.minimum(lengths, LENGTHS) - 1
        return np.where(self.hashes[at] == hashes, self.numbers[at], rest) if len(self.hashes) else rest


class Shares(NamedTuple):
    """Logarithms of the counts of rare words (by sorted hash), and of their sums for each length."""

    hashes: np.ndarray
    logs: np.ndarray
    sums: np.ndarray

    def of(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The logarithm of each word's count, 0 where it is not held, and whether it is."""
        if not len(self.hashes):
            return np.zeros(len(hashes)), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        held = self.hashes[at] == hashes
        return np.where(held, self.logs[at], 0.0), held


def _words(batch: pa.RecordBatch):
    """For each chunk: its first row, word spans and hashes; A-Z are read as a-z."""
    for chunk in chunks(batch.column(1)):
        data = LOWER[chunk.data]
        words = spans(data, chunk.offsets, WORD)
        yield chunk, words, Hasher(data)(words.starts, words.ends)


def count_words(docs: DataFrame) -> DataFrame:
    """``word`` (hash), ``length`` and ``n`` over the whole corpus; each task adds up its own words first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def compact() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            keys, lengths, counts = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(keys)
            keys, lengths, counts = keys[order], lengths[order], counts[order]
            begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            return keys[begin], lengths[begin], np.add.reduceat(counts, begin)

        def send() -> Iterator[pa.RecordBatch]:
            keys, lengths, counts = compact()
            for a in range(0, len(keys), 1 << 16):
                part = slice(a, a + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(keys[part].view(np.int64)), pa.array(lengths[part]), pa.array(counts[part])], names=["word", "length", "n"])

        for batch in batches:
            for _, words, hashes in _words(batch):
                if len(hashes):
                    keys, first, counts = np.unique(hashes, return_index=True, return_counts=True)
                    lengths = np.minimum((words.ends - words.starts)[first], LENGTHS).astype(np.int32)
                    held.append((keys, lengths, counts))
                    size += len(keys)
            if size > COUNT_BUFFER:
                held = [compact()]
                size = len(held[0][0])
                if size > COUNT_BUFFER // 2:
                    yield from send()
                    held, size = [], 0
        if size:
            yield from send()

    found = documents(docs).mapInArrow(run, "word long, length int, n long")
    return found.groupBy("word").agg(F.min("length").alias("length"), F.sum("n").alias("n"))


def choose_units(docs: DataFrame, counts: DataFrame | None = None) -> Units:
    """The most frequent words of the corpus as units; frequent words share groups with frequent ones."""
    counts = count_words(docs) if counts is None else counts
    top = counts.orderBy(F.desc("n"), "word").limit(UNITS - LENGTHS - 1).collect()
    hashes = np.array([r["word"] for r in top], np.int64).view(U64)
    order = np.argsort(hashes)
    return Units(hashes[order], 1 + order)


def choose_shares(counts: DataFrame, found: Units, most: int = HELD) -> Shares:
    """The sums of rare words by length, and the counts of the most frequent of them, ``most`` at most."""
    rare = counts.where(~F.col("word").isin(found.hashes.view(np.int64).tolist()))
    power = F.length(F.bin("n"))  # counts of equal powers of two are held together or not at all
    sums, sizes = np.ones(LENGTHS), {}
    for r in rare.groupBy("length", power.alias("power")).agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect():
        sums[r["length"] - 1] += r["n"]
        sizes[r["power"]] = sizes.get(r["power"], 0) + r["words"]
    sums -= sums > 1
    least, size = 64, 0
    for k in sorted(sizes, reverse=True):
        if k < 2 or size + sizes[k] > most:  # words counted once need no look-up
            break
        least, size = k, size + sizes[k]
    held = rare.where(power >= least).select("word", "n").toArrow()
    hashes = held.column("word").to_numpy().view(U64)
    order = np.argsort(hashes)
    return Shares(hashes[order], np.log(held.column("n").to_numpy()[order]), np.log(sums))


class Network:
    """The weights, as parts of one flat vector."""

    def __init__(self, flat: np.ndarray):
        self.flat, at = flat, 0
        for name, shape in SHAPES.items():
            n = int(np.prod(shape))
            setattr(self, name, flat[at:at + n].reshape(shape))
            at += n

    @classmethod
    def new(cls) -> Network:
        rng = np.random.default_rng(11)
        net = cls(rng.normal(0, 0.1, SIZE).astype(np.float32))
        for part in (net.hidden, net.group_bias, net.unit_bias):
            part[:] = 0
        return net

    def tables(self) -> np.ndarray:
        """What each unit adds to the hidden layer at each place."""
        return np.einsum("ue,peh->puh", self.embed, self.place)

    def hidden_of(self, tables: np.ndarray, units: np.ndarray, at: np.ndarray) -> np.ndarray:
        total = np.repeat(self.hidden[None], len(at), 0)
        for table, place in zip(tables, PLACES):
            total += table[units[at + place]]
        return np.tanh(total, out=total)


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x -= x.max(axis=1, keepdims=True)
    x -= np.log(np.exp(x).sum(axis=1, keepdims=True))
    return x


def log_probabilities(net: Network, tables: np.ndarray, units: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The logarithm of each masked unit's probability, given its neighbours."""
    out = np.empty(len(at), np.float32)
    width = UNITS // GROUPS
    bias = net.unit_bias.reshape(GROUPS, width)
    for a in range(0, len(at), 1 << 15):
        part = at[a:a + (1 << 15)]
        target = units[part]
        order = np.argsort(target, kind="stable")
        part, target = part[order], target[order]
        hidden = net.hidden_of(tables, units, part)
        groups = _log_softmax(hidden @ net.group + net.group_bias)
        held = groups[np.arange(len(part)), target // width]
        cuts = np.searchsorted(target, np.arange(GROUPS + 1) * width)
        for g, (i, j) in enumerate(zip(cuts, cuts[1:])):
            if i < j:
                inner = _log_softmax(hidden[i:j] @ net.unit[g] + bias[g])
                held[i:j] += inner[np.arange(j - i), target[i:j] - g * width]
        out[a + order] = held
    return out


def step(net: Network, squares: np.ndarray, units: np.ndarray, at: np.ndarray, rate: float = RATE) -> None:
    """One step of Adagrad on the masked places ``at``."""
    width, n = UNITS // GROUPS, len(at)
    order = np.argsort(units[at], kind="stable")
    at = at[order]
    target = units[at]
    slope = Network(np.zeros(SIZE, np.float32))
    hidden = net.hidden_of(net.tables(), units, at)
    error = np.exp(_log_softmax(hidden @ net.group + net.group_bias))
    error[np.arange(n), target // width] -= 1
    slope.group[:] = hidden.T @ error
    slope.group_bias[:] = error.sum(axis=0)
    back = error @ net.group.T
    bias, bias_slope = net.unit_bias.reshape(GROUPS, width), slope.unit_bias.reshape(GROUPS, width)
    cuts = np.searchsorted(target, np.arange(GROUPS + 1) * width)
    for g, (i, j) in enumerate(zip(cuts, cuts[1:])):
        if i < j:
            inner = np.exp(_log_softmax(hidden[i:j] @ net.unit[g] + bias[g]))
            inner[np.arange(j - i), target[i:j] - g * width] -= 1
            slope.unit[g] = hidden[i:j].T @ inner
            bias_slope[g] = inner.sum(axis=0)
            back[i:j] += inner @ net.unit[g].T
    back *= 1 - hidden * hidden
    slope.hidden[:] = back.sum(axis=0)
    for k, place in enumerate(PLACES):
        near = units[at + place]
        by = np.argsort(near, kind="stable")
        near = near[by]
        begin = np.flatnonzero(np.concatenate([[True], near[1:] != near[:-1]]))
        seen, sums = near[begin], np.add.reduceat(back[by], begin)
        slope.embed[seen] += sums @ net.place[k].T
        slope.place[k] = net.embed[seen].T @ sums
    gradient = slope.flat / n
    squares += gradient * gradient
    net.flat -= rate * gradient / np.sqrt(squares)


def _units_with_edges(found: Units, words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Units of all documents of a chunk with empty units between them, and the words' places."""
    owners = words.owners()
    at = np.arange(len(hashes)) + REACH * (owners + 1)
    units = np.zeros(len(hashes) + REACH * (len(words.first) + 1), np.int64)
    units[at] = found.of(hashes, words.ends - words.starts)
    return units, at


def train_round(docs: DataFrame, found: Units, start: np.ndarray, turn: int) -> np.ndarray:
    """One round: a copy of the network for each task, averaged by the words it has seen."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, squares, seen = Network(start.copy()), np.full(SIZE, 1e-6, np.float32), 0
        rng = np.random.default_rng([turn, TaskContext.get().partitionId()])
        held, places, size, base = [], [], 0, 0
        for batch in batches:
            for _, words, hashes in _words(batch):
                units, at = _units_with_edges(found, words, hashes)
                at = at[rng.random(len(at)) < MASKED]
                held.append(units)
                places.append(at + base)
                base, size = base + len(units), size + len(at)
                if size >= BATCH:
                    units, at = np.concatenate(held), np.concatenate(places)
                    for a in range(0, len(at), BATCH):
                        step(net, squares, units, at[a:a + BATCH])
                    seen += len(at)
                    held, places, size, base = [], [], 0, 0
        if size:
            step(net, squares, np.concatenate(held), np.concatenate(places))
            seen += size
        if seen:
            for a in range(0, SIZE, 4096):
                yield pa.RecordBatch.from_arrays([pa.array([a], pa.int64()), pa.array([float(seen)]), pa.array([net.flat[a:a + 4096]], pa.list_(pa.float32()))], names=["first", "seen", "weights"])

    copies = documents(docs).mapInArrow(run, "first long, seen double, weights array<float>")
    each = copies.select("first", "seen", F.posexplode("weights").alias("i", "w"))
    mean = each.groupBy((F.col("first") + F.col("i")).alias("at")).agg((F.sum(F.col("w") * F.col("seen")) / F.sum("seen")).alias("w"))
    rows = mean.collect()  # one for each weight of the network
    if not rows:
        return start
    flat = np.zeros(SIZE, np.float32)
    flat[[r["at"] for r in rows]] = [r["w"] for r in rows]
    return flat


def train(docs: DataFrame, found: Units) -> np.ndarray:
    """The weights after all rounds."""
    prepare(docs.sparkSession)
    flat = Network.new().flat
    for turn in range(TRAIN_ROUNDS):
        flat = train_round(docs, found, flat, turn)
    return flat


def _rare_words(keyed: DataFrame, found: Units, shares: Shares) -> DataFrame:
    """``key``, ``word`` and ``n`` of each document's rare words whose counts the tasks do not hold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(2).to_numpy()
            for chunk, words, hashes in _words(batch):
                rare = found.of(hashes, words.ends - words.starts) >= UNITS - LENGTHS
                rare[rare] = ~shares.of(hashes[rare])[1]
                owners, left = words.owners()[rare], hashes[rare]
                order = np.lexsort((left, owners))
                owners, left = owners[order], left[order]
                begin = np.flatnonzero(np.concatenate([[len(left) > 0], (left[1:] != left[:-1]) | (owners[1:] != owners[:-1])])) if len(left) else np.zeros(0, int)
                counts = np.diff(np.append(begin, len(left))).astype(np.int32)
                for a in range(0, len(begin), 1 << 16):
                    at = begin[a:a + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(keys[chunk.first + owners[at]]), pa.array(left[at].view(np.int64)), pa.array(counts[a:a + (1 << 16)])], names=["key", "word", "n"])

    return keyed.mapInArrow(run, "key long, word long, n int")


def score_documents(docs: DataFrame, found: Units, flat: np.ndarray, counts: DataFrame | None = None) -> DataFrame:
    """doc_id, n_words, log_likelihood (the sum) and mean_log_likelihood of each document.

    With ``counts`` of words a rare word is scored as itself, without them as any word of its length.
    """
    prepare(docs.sparkSession)
    shares = None if counts is None else choose_shares(counts, found)

    def work(batch: pa.RecordBatch) -> list:
        net = Network(flat)
        tables, numbers, sums = net.tables(), [], []
        for _, words, hashes in _words(batch):
            units, at = _units_with_edges(found, words, hashes)
            logs = log_probabilities(net, tables, units, at).astype(float)
            if shares is not None:
                lengths = units[at] - (UNITS - LENGTHS)
                rare = np.flatnonzero(lengths >= 0)
                logs[rare] += shares.of(hashes[rare])[0] - shares.sums[lengths[rare]]
            numbers.append(np.diff(words.first))
            sums.append(np.bincount(words.owners(), logs, len(words.first) - 1).astype(float))
        return [batch.column(0), batch.column(2), pa.array(np.concatenate(numbers).astype(np.int64)), pa.array(np.concatenate(sums), pa.float64())]

    keyed = documents(docs).withColumn("key", F.xxhash64("doc_id", "text"))
    scored = by_batch(keyed, work, "doc_id long, key long, n_words long, total double")
    if counts is not None:
        known = counts.where("n > 1").select("word", F.log("n").alias("log"))  # the logarithm of one is 0
        more = _rare_words(keyed, found, shares).join(known, "word").groupBy("key").agg(F.sum(F.col("n") * F.col("log")).alias("more"))
        # Rows with the same id and text have one key, and their words are summed together.
        scored = scored.withColumn("copies", F.count("*").over(Window.partitionBy("key"))).join(more, "key", "left")
        scored = scored.withColumn("total", F.col("total") + F.coalesce(F.col("more") / F.col("copies"), F.lit(0.0)))
    mean = F.when(F.col("n_words") > 0, F.col("total") / F.col("n_words"))
    return scored.select("doc_id", "n_words", F.col("total").alias("log_likelihood"), mean.alias("mean_log_likelihood"))


def pseudo_likelihood(docs: DataFrame) -> DataFrame:
    """Count words, choose units, train on all documents and score them."""
    prepare(docs.sparkSession)
    counts = written(count_words(docs), "word-counts")
    found = choose_units(docs, counts)
    return score_documents(docs, found, train(docs, found), counts)
