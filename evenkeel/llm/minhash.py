"""Near-duplicates: banded signatures, sequential Bayesian verification, exact links.

1. A document's set holds the distinct shingles of ``shingle`` words (fewer words: the sequence
   as one). Documents of one set are one class; only classes go on.
2. Signatures of ``bands * rows`` minimum hashes; two classes are candidates if a band is equal.
   Bands are as many as keep the chance to miss a link at the threshold under ``MISS``.
3. In each bucket all members are compared with one centre, not with each other. Signatures are
   compared batch by batch: with ``m`` of ``n`` equal, the posterior of the similarity is
   Beta(m + 1, n - m + 1), and a pair goes as soon as it is at the threshold with a probability
   under ``MISS``. Survivors are verified on the full sets, each class with its best centre first.
4. Links merge classes into components. The members of buckets that still hold several
   components make groups, by the most frequent component; members of other components are
   compared with all of their group, in blocks, by signatures and then by the full sets, so that
   no link between different components is left out. Centres not yet tried are verified as well
   where they would join two components.

A component's links within itself are not all verified, as they would not change it. Work within a
group grows with its members times those that no centre has linked, not with its square.

Cases: null, empty and blank texts have no set and are linked with nothing; rows that repeat a
doc_id are each linked by their own text; rows with a null doc_id are linked with nothing and
kept, with a null component; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.components import components, steps_down
from evenkeel.llm.shared import Scratch, by_batch, documents, extended, prepare
from evenkeel.llm.words import LOWER, U64, WORD, Chunk, Hasher, chunks, mix, spans, windows
from evenkeel.session import written

MISS = 1e-6
ROWS, BATCH = 5, 24
#: Members of one block of signatures.
BLOCK = 64
_LOW = (1 << 56) - 1


def bands_for(percent: int) -> int:
    """So many bands that a pair at the threshold shares none with a chance under MISS."""
    return ceil(log(MISS) / log(1 - (percent / 100) ** ROWS))


def _sets(chunk: Chunk, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each document, sorted: 56-bit values, and where each document's begin."""
    data = LOWER[chunk.data]
    words = spans(data, chunk.offsets, WORD)
    hashes, n = Hasher(data)(words.starts, words.ends), len(chunk.offsets) - 1
    rolled, _, begins = windows(hashes, words.first, shingle)
    sizes = np.diff(words.first)
    owners = np.repeat(np.arange(n), np.diff(begins))
    for fewer in range(1, shingle):
        docs = np.flatnonzero(sizes == fewer)
        if len(docs):
            whole = hashes[words.first[docs]]
            for i in range(1, fewer):
                whole = mix(whole) + hashes[words.first[docs] + i]
            rolled, owners = np.concatenate([rolled, mix(whole + U64(fewer))]), np.concatenate([owners, docs])
    held = np.sort((owners.astype(U64) << U64(56)) | (rolled >> U64(8)))
    held = held[np.concatenate([[True], held[1:] != held[:-1]])] if len(held) else held
    return held & U64(_LOW), np.searchsorted(held >> U64(56), np.arange(n + 1))


def _prints(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Two 64-bit digests of each document's set; those of an empty set are 0."""
    sums = [np.concatenate([[U64(0)], np.cumsum(mix(values + U64(salt)))]) for salt in (1, 0x5DEECE66D)]
    return np.stack([mix(s[begins[1:]] - s[begins[:-1]]) for s in sums])


def _signatures(values: np.ndarray, begins: np.ndarray, size: int) -> np.ndarray:
    """``size`` minimum hashes, 16 bits of each."""
    rng = np.random.default_rng(20231)
    flip = rng.integers(0, 1 << 32, size, dtype=np.uint32)
    times = rng.integers(0, 1 << 32, size, dtype=np.uint32) | np.uint32(1)
    out = np.zeros((len(begins) - 1, size), np.uint16)
    filled = np.flatnonzero(np.diff(begins) > 0)
    if len(filled):
        short = (mix(values) >> U64(32)).astype(np.uint32)
        for k in range(size):
            least = np.minimum.reduceat((short ^ flip[k]) * times[k], begins[filled])
            out[filled, k] = (least * np.uint32(0x9E3779B1)) >> np.uint32(16)
    return out


def signatures(docs: DataFrame, shingle: int, percent: int, *others: str) -> DataFrame:
    """doc_id, n_shingles, two digests of the set and the signature of each row, and other columns."""
    size = bands_for(percent) * ROWS
    held = documents(docs, *others)

    def work(batch: pa.RecordBatch) -> list:
        counts, prints, held = [], [], []
        for chunk in chunks(batch.column(1)):
            values, begins = _sets(chunk, shingle)
            counts.append(np.diff(begins))
            prints.append(_prints(values, begins).view(np.int64))
            held.extend(row.tobytes() for row in _signatures(values, begins, size))
        first, second = np.concatenate(prints, axis=1)
        return [batch.column(0), pa.array(np.concatenate(counts).astype(np.int64)), pa.array(first), pa.array(second), pa.array(held, pa.binary()), *(batch.column(c) for c in others)]

    return by_batch(held, work, extended("doc_id long, n_shingles long, c long, d long, sig binary", held, others))


def least_equal(percent: int, size: int) -> list[tuple[int, int]]:
    """For each batch end ``n``: the fewest equal hashes for which the posterior keeps a pair."""
    grid = np.linspace(0, 1, 20001)[1:-1]
    above = grid >= percent / 100
    out = []
    for n in [*range(BATCH, size, BATCH), size]:
        for m in range(n + 1):
            logs = m * np.log(grid) + (n - m) * np.log1p(-grid) + lgamma(n + 2) - lgamma(m + 1) - lgamma(n - m + 1)
            if np.exp(logs[above]).sum() / len(grid) >= MISS:
                break
        out.append((n, m))
    return out


def _agreeing(a: np.ndarray, b: np.ndarray, bounds: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of two equally long lists of signatures that survive, and how many hashes are equal."""
    alive, equal, done = np.arange(len(a)), np.zeros(len(a), np.int64), 0
    for n, least in bounds:
        equal[alive] += (a[alive, done:n] == b[alive, done:n]).sum(axis=1)
        alive, done = alive[equal[alive] >= least], n
    return alive, equal[alive]


def _stack(column: pa.Array, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, size)


def _buckets(classes: DataFrame, size: int) -> DataFrame:
    """``key, c`` for each band of each class."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            held = _stack(batch.column(1), size).astype(U64).reshape(batch.num_rows, -1, ROWS)
            keys = np.arange(held.shape[1], dtype=U64)[None, :].repeat(batch.num_rows, 0)
            for i in range(ROWS):
                keys = mix(keys * U64(0xD6E8FEB86659FD93) + held[:, :, i] + U64(1))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.asarray(batch.column(0)).repeat(held.shape[1]))], names=["key", "c"])

    return classes.select("c", "sig").mapInArrow(run, "key long, c long")


def _survivors(pairs: DataFrame, classes: DataFrame, percent: int, size: int) -> DataFrame:
    """Pairs (a, b) whose signatures keep them, with the number of equal hashes."""
    side = lambda name: classes.select(F.col("c").alias(name), F.col("n_shingles").alias(f"n_{name}"), F.col("sig").alias(f"sig_{name}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    fits = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    bounds = least_equal(percent, size)

    def work(batch: pa.RecordBatch) -> list:
        alive, equal = _agreeing(_stack(batch.column(2), size), _stack(batch.column(3), size), bounds)
        at = pa.array(alive)
        return [batch.column(0).take(at), batch.column(1).take(at), pa.array(equal)]

    return by_batch(joined.where(fits).select("a", "b", "sig_a", "sig_b"), work, "a long, b long, equal long")


def _full_sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """``c, set`` of the wanted classes (``c``, ``rep``), from the whole text of one document each."""
    def work(batch: pa.RecordBatch) -> list:
        prints, held = [], []
        for chunk in chunks(batch.column(1)):
            values, begins = _sets(chunk, shingle)
            prints.append(_prints(values, begins)[0].view(np.int64))
            held.extend(values[a:b].tobytes() for a, b in zip(begins, begins[1:]))
        return [batch.column(2), pa.array(np.concatenate(prints)), pa.array(held, pa.binary())]

    texts = documents(docs).join(wanted.select(F.col("rep").alias("doc_id"), "c"), "doc_id")
    found = by_batch(texts.select("doc_id", "text", "c"), work, "c long, own long, set binary")
    return found.where(F.col("c") == F.col("own")).groupBy("c").agg(F.first("set").alias("set"))


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two full sets (sorted) are alike by so many percent."""
    both = np.concatenate([x, y])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(both) - shared)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are linked, by their full sets."""
    side = lambda name: sets.select(F.col("c").alias(name), F.col("set").alias(f"set_{name}"))
    joined = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "set_a", "set_b")

    def work(batch: pa.RecordBatch) -> list:
        sets = ([np.frombuffer(v.as_buffer(), U64) for v in batch.column(i)] for i in (2, 3))
        linked = [_linked(x, y, percent) for x, y in zip(*sets)]
        return [batch.column(0), batch.column(1), pa.array(linked, pa.bool_())]

    return by_batch(joined, work, "a long, b long, linked boolean").where("linked").select("a", "b")


def _group_links(members: DataFrame, percent: int, size: int) -> DataFrame:
    """Links (a, b) between the outsiders of each group and all of its members.

    ``members`` has group (the label most of it has), n (its size), c, label, n_shingles, sig and
    set. Outsiders, whose label is another, meet all members in blocks: signatures are compared
    first, survivors by their full sets there and then. One link for each outsider and label is
    enough, as links are only counted on to join components.
    """
    bounds = least_equal(percent, size)
    count = F.ceil(F.col("n") / BLOCK).cast("int")
    blocks = members.withColumn("block", F.pmod(F.xxhash64("c"), count).cast("int"))
    packed = F.collect_list(F.struct("c", "label", "n_shingles", "sig", "set"))
    everyone = blocks.groupBy("group", "block").agg(packed.alias("all_"))
    outside = blocks.where(F.col("label") != F.col("group")).groupBy("group", F.col("block").alias("other")).agg(
        packed.alias("out_"), F.first("n").alias("n"))
    # Each block of outsiders goes to each block of its group, so no task gathers a group.
    outside = outside.select("group", "out_", F.explode(F.sequence(F.lit(0), count - 1)).alias("block"))

    def parts(lists: pa.Array) -> tuple:
        flat = lists.flatten()
        sets = [np.frombuffer(v.as_buffer(), U64) for v in flat.field(4)]
        return (*(np.asarray(flat.field(i)) for i in range(3)), _stack(flat.field(3), size), sets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                c, label, counts, sig, sets = parts(batch.column(0).slice(row, 1))
                c2, label2, counts2, sig2, sets2 = parts(batch.column(1).slice(row, 1))
                fits = 100 * np.minimum(counts[:, None], counts2) >= percent * np.maximum(counts[:, None], counts2)
                i, j = np.nonzero((label[:, None] != label2) & fits)
                alive, equal = _agreeing(sig[i], sig2[j], bounds)
                best = alive[np.argsort(-equal, kind="stable")]
                found: dict[tuple[int, int], tuple[int, int]] = {}
                for x, y in zip(i[best].tolist(), j[best].tolist()):
                    if (x, label2[y]) not in found and _linked(sets[x], sets2[y], percent):
                        found[x, label2[y]] = int(c[x]), int(c2[y])
                if found:
                    a, b = zip(*found.values())
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return outside.join(everyone, ["group", "block"]).select("out_", "all_").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, *others: str, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row, and other columns."""
    prepare(docs.sparkSession)
    size, scratch = bands_for(percent) * ROWS, Scratch(docs.sparkSession)
    # Other columns travel in one struct, so that none clashes with a column of ours.
    docs = documents(docs).withColumn("_others", F.lit(0)) if not others else docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct(*others).alias("_others"))
    rows = written(signatures(docs, shingle, percent, "_others"), "signatures")
    known = rows.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = scratch.written(known.groupBy("c", "d", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig")), "classes")
    reps = classes.select("c", "rep")
    buckets = _buckets(classes, size)
    centres = scratch.written(buckets.groupBy("key").agg(F.min("c").alias("b"), F.count("*").alias("n")).where("n > 1"), "centres")
    pairs = buckets.withColumnRenamed("c", "a").join(centres.select("key", "b"), "key").where("a != b")
    survivors = scratch.written(_survivors(pairs.groupBy("a", "b").agg(F.count("*").alias("bands")).drop("bands"), classes, percent, size), "survivors")

    # Each class with its best centre first.
    best = survivors.groupBy("a").agg(F.max_by("b", F.struct("equal", "b")).alias("b"))
    involved = survivors.select(F.col("a").alias("c")).union(survivors.select(F.col("b").alias("c"))).distinct()
    sets = scratch.written(_full_sets(docs, involved.join(reps, "c"), shingle), "sets")
    links = scratch.written(_verified(best, sets, percent), "verified")

    # Buckets that still hold several parts: their members make groups, by the most frequent one.
    # A few steps from centre to centre tell most parts; a part told twice is only compared again.
    tied = steps_down(links.select(F.col("a").alias("node"), F.col("b").alias("parent")), 3)
    label = scratch.written(tied.select(F.col("node").alias("c"), F.col("parent").alias("label")), "labels")
    held = buckets.join(centres.where("n > 2").select("key"), "key").join(label, "c", "left")
    held = scratch.written(held.select("key", "c", F.coalesce("label", "c").alias("label")), "members")
    counted = held.groupBy("key", "label").agg(F.count("*").alias("n"))
    opened = counted.groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("group"), F.count("*").alias("kinds"))
    inside = held.join(opened.where("kinds > 1").select("key", "group"), "key").select("group", "c", "label").distinct()
    inside = scratch.written(inside, "groups")
    lacking = scratch.written(inside.select("c").distinct().join(sets.select("c"), "c", "left_anti").join(reps, "c"), "lacking")
    if not lacking.isEmpty():
        sets = sets.unionByName(scratch.written(_full_sets(docs, lacking, shingle), "sets"))
    sizes = inside.groupBy("group").agg(F.count("*").alias("n"))
    full = inside.join(sizes, "group").join(classes.select("c", "n_shingles", "sig"), "c").join(sets, "c")
    joining = scratch.written(_group_links(full, percent, size), "joining")

    # Centres not yet tried, where they would join two components.
    side = lambda name: label.select(F.col("c").alias(name), F.col("label").alias(f"label_{name}"))
    rest = survivors.select("a", "b").join(best, ["a", "b"], "left_anti").join(side("a"), "a", "left").join(side("b"), "b", "left")
    rest = scratch.written(rest.where(F.coalesce("label_a", "a") != F.coalesce("label_b", "b")).select("a", "b"), "rest")
    labels = components(links.unionByName(joining).unionByName(_verified(rest, sets, percent)))

    roots = reps.join(labels.select(F.col("node").alias("c"), "root"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    roots = scratch.written(roots, "roots")
    least = roots.groupBy("root").agg(F.min("rep").alias("component"))
    found = written(roots.join(scratch.written(least, "least"), "root").select("c", "component"), "components")
    scratch.drop()  # the result reads only the signatures and the components
    linked = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("c"))
    out = rows.withColumn("c", linked).join(found, "c", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
                      *(F.col(f"_others.`{c}`").alias(c) for c in others))
