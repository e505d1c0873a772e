"""Content and boilerplate lines by a linear-chain conditional random field.

A text's lines are a sequence. Each line has binary features (length, shares of symbols, capitals,
digits and repeated words, closing sign, equal to an earlier line, ...), and the field scores a
labelling by the features of each line and by the pairs of labels of neighbouring lines. It is
trained by its exact likelihood (forward and backward sums, in numpy) on a bounded sample of
``SAMPLE`` documents with a quality label, whose lines, all of them, take the label of their document.
The driver holds 3 bytes of features a line, equal lines have one row in training, and a text of
very many lines is summed in stretches of ``STRETCH`` side by side.
Viterbi decoding finds the best labelling of every document; those are kept whose content lines
hold at least ``SHARE`` of their words.

Cases: null, empty and blank texts have no words, fail the base rule and are not kept; a text
without a line break is one line; lines without a word belong to the sequence but have no share;
without labels of both kinds the weights are zero and every line is content; repeated rows are
judged each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.shared import by_batch, documents, extended, prepare
from evenkeel.llm.words import U64, WORD, Chunk, Hasher, chunks, cover, mix, spans, table, windows

#: The bound of the labelled sample; all lines of its documents are taken.
SAMPLE = 4_000
SHARE = 0.5
ROUNDS, STEP, L2 = 250, 0.5, 1e-4
#: Longer sequences are summed in stretches of so many lines, joined by their 2 x 2 sums.
STRETCH = 512

SYMBOL = table(b"#*$%&|<>", False)
BREAK = table(b"\n", True)
UPPER = table(bytes(range(65, 91)), False)
LOWERCASE = table(bytes(range(97, 123)), False)
DIGIT = table(b"0123456789", False)
CLOSING = table(b".!?:;", False)
SHOUT = table(b"!?", False)

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


class Measured(NamedTuple):
    """Base counts of each document of a chunk, and its lines: first line, words and features."""

    counts: np.ndarray
    first: np.ndarray
    line_words: np.ndarray
    features: np.ndarray


def _repeated(hashes: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flags: equal to another of the same document; equal to an earlier one."""
    if not len(hashes):
        return np.zeros(0, bool), np.zeros(0, bool)
    keys = mix(hashes ^ (owners.astype(U64) * U64(0x9E3779B97F4A7C15)))
    order = np.argsort(keys, kind="stable")
    same = np.concatenate([[False], keys[order][1:] == keys[order][:-1]])
    later, any_ = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order] = same
    any_[order] = same | np.append(same[1:], False)
    return any_, later


def _sums(flags: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])


def measure(chunk: Chunk) -> Measured:
    """Count what the rules need, and describe every line."""
    data, offsets = chunk.data, chunk.offsets
    n = len(offsets) - 1
    hasher = Hasher(data)
    words = spans(data, offsets, WORD)
    hashes, owners = hasher(words.starts, words.ends), words.owners()
    rolled, at, begins = windows(hashes, words.first, 5)
    twice, _ = _repeated(rolled, np.repeat(np.arange(n), np.diff(begins)))
    repeat = cover(len(hashes), at[twice], 5)
    # Lines: cut at every line break and at the edges of documents.
    breaks = np.flatnonzero(data == 10)
    owner = np.searchsorted(offsets, breaks, "right") - 1
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([offsets[1:], breaks]), kind="stable")
    first = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n) + 1)])
    line_owner = np.repeat(np.arange(n), np.diff(first))
    word_at = np.searchsorted(words.starts, starts), np.searchsorted(words.starts, ends)
    line_words = word_at[1] - word_at[0]
    filled = np.flatnonzero(line_words > 0)
    line_hash = hasher(starts[filled], ends[filled]) ^ mix((ends - starts)[filled].astype(U64))
    _, dup = _repeated(line_hash, line_owner[filled])
    earlier = np.zeros(len(starts), bool)
    earlier[filled] = dup
    character = _sums((data & 0xC0) != 0x80)
    per_doc = lambda sums, a, b: sums[b] - sums[a]
    symbols = _sums(SYMBOL[data])
    spelled = _sums(WORD[data] & ((data & 0xC0) != 0x80))
    repeats = _sums(repeat)
    counts = np.stack([
        np.diff(words.first), per_doc(spelled, offsets[:-1], offsets[1:]), per_doc(symbols, offsets[:-1], offsets[1:]),
        np.bincount(line_owner, earlier, n).astype(np.int64), per_doc(repeats, words.first[:-1], words.first[1:])])
    # Features of lines, all 0 or 1.
    length = np.maximum(1, per_doc(character, starts, ends))
    share = lambda flags: per_doc(_sums(flags[data]), starts, ends) / length
    per_word = lambda sums: per_doc(sums, *word_at) / np.maximum(1, line_words)
    same = _sums(np.concatenate([[False], (hashes[1:] == hashes[:-1]) & (owners[1:] == owners[:-1])]) if len(hashes) else np.zeros(0, bool))
    last_byte = data[np.maximum(0, np.minimum(ends, len(data)) - 1)] if len(data) else np.zeros(len(starts), np.uint8)
    symbol, upper, digit = share(SYMBOL), share(UPPER), share(DIGIT)
    shout = share(SHOUT)
    columns = [
        np.ones(len(starts), bool), line_words == 0, (line_words > 0) & (line_words < 3), line_words > 40,
        symbol > 0, symbol > 0.05, symbol > 0.15, upper > 0.2, upper > 0.6, digit > 0.15, digit > 0.4,
        shout > 0.02, shout > 0.1, earlier, per_word(repeats) > 0.3, per_word(same) > 0.3,
        CLOSING[last_byte] & (ends > starts), share(LOWERCASE) > 0.6, length / np.maximum(1, line_words) > 15]
    return Measured(counts, first, line_words, np.stack(columns, axis=1))


class Field(NamedTuple):
    """Weights of features for content against boilerplate, and of neighbouring labels."""

    emit: np.ndarray
    move: np.ndarray


def _by_step(first: np.ndarray):
    """For each line number: the sequences that have such a line, and the line's place."""
    sizes = np.diff(first)
    order = np.argsort(-sizes, kind="stable")
    for step in range(int(sizes.max()) if len(sizes) else 0):
        live = order[:int(np.searchsorted(-sizes[order], -step, "left"))]
        yield live, first[:-1][live] + step


def viterbi(field: Field, features: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The best labels (1 for content) of each sequence of lines; content wins ties."""
    emit = np.zeros((len(features), 2))
    emit[:, 1] = features @ field.emit
    best, came = np.zeros((len(first) - 1, 2)), np.zeros((len(features), 2), np.int8)
    steps = list(_by_step(first))
    for k, (live, at) in enumerate(steps):
        if k:
            paths = best[live][:, :, None] + field.move[None]
            came[at] = np.where(paths[:, 1] >= paths[:, 0], 1, 0)
            best[live] = paths.max(axis=1)
        best[live] += emit[at]
    labels, now = np.zeros(len(features), np.int8), (best[:, 1] >= best[:, 0]).astype(np.int8)
    sizes = np.diff(first)
    for k in range(len(steps) - 1, -1, -1):
        live, at = steps[k]
        inner = sizes[live] > k + 1
        now[live[inner]] = came[at[inner] + 1, now[live[inner]]]
        labels[at] = now[live]
    return labels


def train(features: np.ndarray, labels: np.ndarray, first: np.ndarray) -> Field:
    """Maximise the likelihood of labelled sequences by gradient steps."""
    emit, move = np.zeros(features.shape[1]), np.zeros((2, 2))
    n_docs = len(first) - 1
    if not n_docs or labels.min() == labels.max():
        return Field(emit, move)
    cuts = np.concatenate([np.arange(a, b, STRETCH) for a, b in zip(first, first[1:])] + [first[-1:]])
    steps, of_doc = list(_by_step(cuts)), np.searchsorted(cuts, first)
    opens = np.zeros(len(cuts) - 1, bool)  # stretches that begin a document
    opens[of_doc[:-1]] = True
    later, chain = np.flatnonzero(~opens), list(_by_step(of_doc))
    long = np.repeat(np.diff(of_doc) > 1, np.diff(of_doc))
    inner = [(live[long[live]], at[long[live]]) for live, at in steps] if len(later) else []
    follows = [at for _, at in steps[1:]] + ([cuts[later]] if len(later) else [])
    lengths = np.repeat(np.diff(first), np.diff(first))
    weight = 1 / lengths  # each document counts once
    kind = np.where(labels == 1, 1 / max(1.0, (weight * labels).sum()), 1 / max(1.0, (weight * (1 - labels)).sum())) * n_docs / 2
    weight = weight * kind
    seen = np.zeros((2, 2))
    for at in follows:
        np.add.at(seen, (labels[at - 1], labels[at]), weight[at])
    # Equal lines share a row of features.
    packed = np.packbits(features, axis=1)
    packed = np.ascontiguousarray(packed).view(np.dtype((np.void, packed.shape[1]))).ravel()
    _, one, row = np.unique(packed, return_index=True, return_inverse=True)
    x, row = features[one].astype(float), row.astype(np.int32)
    emit_sum, move_sum = np.full(len(emit), 1e-8), np.full((2, 2), 1e-8)
    for _ in range(ROUNDS):
        score = np.zeros((len(features), 2))
        score[:, 1] = (x @ emit)[row]
        alpha, beta = score.copy(), np.zeros_like(score)
        if len(later):
            sums = np.zeros((len(opens), 2, 2))  # over a stretch, by the label before it and its last
            for k, (live, at) in enumerate(inner):
                paths = np.where((opens[live] & (k == 0))[:, None, None], 0.0, move) + score[at][:, None, :]
                sums[live] = np.logaddexp.reduce(sums[live][:, :, :, None] + paths[:, None], axis=2) if k else paths
            before, after = np.where(opens[:, None], [0.0, -np.inf], 0.0), np.zeros((len(opens), 2))
            for _, part in chain[1:]:
                before[part] = np.logaddexp.reduce(before[part - 1][:, :, None] + sums[part - 1], axis=1)
            for _, part in reversed(chain[1:]):
                after[part - 1] = np.logaddexp.reduce(sums[part] + after[part][:, None, :], axis=2)
            alpha[cuts[later]] += np.logaddexp.reduce(before[later][:, :, None] + move, axis=1)
            beta[cuts[1:] - 1] = after
        for _, at in steps[1:]:
            alpha[at] += np.logaddexp.reduce(alpha[at - 1][:, :, None] + move, axis=1)
        for _, at in reversed(steps[1:]):
            beta[at - 1] = np.logaddexp.reduce(move[None] + (score[at] + beta[at])[:, None, :], axis=2)
        total = np.logaddexp.reduce(alpha + beta, axis=1)
        content = np.exp(alpha[:, 1] + beta[:, 1] - total)
        gradient = x.T @ np.bincount(row, weight * (labels - content), len(x)) / n_docs - L2 * emit
        expected = np.zeros((2, 2))
        for at in follows:
            pair = alpha[at - 1][:, :, None] + move + (score[at] + beta[at])[:, None, :] - total[at][:, None, None]
            expected += (np.exp(pair) * weight[at][:, None, None]).sum(axis=0)
        move_gradient = (seen - expected) / n_docs - L2 * move
        emit_sum += gradient ** 2
        move_sum += move_gradient ** 2
        emit = emit + STEP * gradient / np.sqrt(emit_sum)
        move = move + STEP * move_gradient / np.sqrt(move_sum)
    return Field(emit, move)


def fit(docs: DataFrame, labels: DataFrame) -> Field:
    """Train on a bounded sample of documents with a quality label."""
    prepare(docs.sparkSession)
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("quality"))
    # Half of the sample of either label, as far as there are so many.
    halves = [known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(SAMPLE // 2) for q in (0, 1)]
    texts = documents(docs).join(F.broadcast(halves[0].union(halves[1])), "doc_id").select("doc_id", "text", "quality")

    def gather(batch: pa.RecordBatch) -> list:
        lines = []
        for chunk in chunks(batch.column(1)):
            found = measure(chunk)
            for a, b in zip(found.first, found.first[1:]):
                lines.append(np.packbits(found.features[a:b], axis=1).tobytes())
        return [batch.column(0), batch.column(2), pa.array(lines, pa.binary())]

    rows = sorted(by_batch(texts, gather, "doc_id long, quality int, lines binary").collect())
    if not rows:
        return Field(np.zeros(len(_NAMES)), np.zeros((2, 2)))
    packed = [np.frombuffer(r["lines"], np.uint8).reshape(-1, (len(_NAMES) + 7) // 8) for r in rows]
    features = np.unpackbits(np.concatenate(packed), axis=1)[:, :len(_NAMES)].astype(bool)
    sizes = [len(p) for p in packed]
    return train(features, np.repeat([r["quality"] for r in rows], sizes), np.concatenate([[0], np.cumsum(sizes)]))


_NAMES = ("any", "blank", "short", "long", "symbol", "symbols", "many symbols", "capitals", "all capitals", "digits", "many digits",
          "shout", "shouts", "earlier", "repeats", "same word", "closed", "lower case", "long words")


def judge(docs: DataFrame, field: Field, share: float = SHARE, *others: str) -> DataFrame:
    """Counts, base_failed, content_words and kept for each document, and other columns."""
    prepare(docs.sparkSession)

    def work(batch: pa.RecordBatch) -> list:
        counts, content = [], []
        for chunk in chunks(batch.column(1)):
            found = measure(chunk)
            labels = viterbi(field, found.features, found.first)
            counts.append(found.counts)
            content.append(np.add.reduceat(found.line_words * labels, found.first[:-1]))
        counted, held = np.concatenate(counts, axis=1), np.concatenate(content).astype(np.int64)
        failed = (counted[0] < 10) | (100 * counted[4] > 20 * counted[0])
        kept = ~failed & (held >= share * counted[0])
        return [batch.column(0), *(pa.array(c.astype(np.int64)) for c in counted), pa.array(failed), pa.array(kept), pa.array(held), *(batch.column(c) for c in others)]

    rows = documents(docs, *others)
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in BASE) + ", base_failed boolean, kept boolean, content_words long"
    return by_batch(rows, work, extended(schema, rows, others))
