"""Phrases whose words keep together, mined from stripes.

Texts are lower-cased (A to Z), cut into pieces at ``.,;:!?`` and line breaks, and pieces into words
at spaces and tabs. All counts are per language.

*Stripes.* A stripe belongs to a prefix of one to three words and counts the words that come next
(one entry stands for "none that matters": the end of a piece, or a word too rare). Each task
builds stripes of what it reads and sends them packed, a segment of prefixes at a time; segments
are merged entry by entry. A merged stripe gives everything that is asked of its prefix:

* its entries: how often each extension by one word occurs;
* its sum: how often the prefix itself occurs;
* its largest entry: the most frequent phrase that begins with the prefix and goes on.

*Rare phrases* cannot be part of a candidate. Words are counted first (stripes of the empty prefix),
then stripes of one word are made of words that are frequent, then those of two and three words
of pairs that are. What is frequent goes to the tasks as a bitmap of hashes of bounded size
(``BITMAP`` bits at most); where it lets too much through, more is counted, and nothing is lost.

*Hot prefixes.* A prefix that occurs more often than a segment has words is dealt to all segments
by its next word, and so are those that it begins. Such prefixes are known from the counts
before, at most ``HOT`` of them; their sums and largest entries are put together from all segments.

Scores use exact decimals. The best of each language are picked in parts, then from the parts' best.

Cases: null and empty texts have no words; a null lang is ``und``; doc_id is not read, so null ids
and rows that repeat count as often as they occur; very long texts are read whole, as chunks of
their own; ties in score go by frequency, then by the phrase's bytes; an empty table gives no rows;
other columns are ignored. Words are told apart by 64 bits of a hash, two words of a language by
chance equal with a probability of about n**2 / 2**65 for n distinct words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.llm.shared import Scratch, prepare
from evenkeel.llm.words import LOWER, U64, Hasher, chunks, mix, spans, table
from evenkeel.session import written

# What ends a piece, what ends a word, the name of a missing language.
BREAKS = table(b".,;:!?\n\v\f\r", False)
INSIDE = table(b" \t.,;:!?\n\v\f\r", True)
NO_LANG = "und"
LONGEST = 4
#: Words for each segment of stripes, about; entries that a task gathers before it sends them.
SEGMENT, BUFFER = 1 << 18, 1 << 22
#: Bits of a bitmap at most, and hot prefixes at most.
BITMAP, HOT = 1 << 27, 1 << 16
#: Parts of a language from which the best are picked.
PARTS = 64

_NONE = U64(0)
_COUNTS = "hash long, lang string, word string, n long"
_PACKED = "segment long, prefixes binary, sizes binary, nexts binary, counts binary"
_MERGED = "prefix long, next long, phrase long, n long, most long"


def joined(prefix: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of phrases, from those of all words but the last and of the last."""
    return mix(prefix * U64(0x9E3779B97F4A7C15) + word) | U64(1)


class Words:
    """The words of a chunk: hashes (with their language), spans, and whether the next one follows in its piece."""

    def __init__(self, chunk, langs: np.ndarray):
        self.data = LOWER[chunk.data]
        found = spans(self.data, chunk.offsets, INSIDE)
        self.starts, self.ends = found.starts, found.ends
        owners = found.owners()
        self.langs = langs[owners]
        self.hashes = mix(Hasher(self.data)(found.starts, found.ends) ^ self.langs) | U64(1)
        piece = np.cumsum(BREAKS[self.data])[found.starts] if len(owners) else owners
        self.follows = np.zeros(len(owners), bool)
        self.follows[:-1] = (owners[1:] == owners[:-1]) & (piece[1:] == piece[:-1])


def read_words(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Words, pa.Array]]:
    """The chunks of (text, lang) batches, with the batch's language names by number."""
    for batch in batches:
        if not batch.num_rows:
            continue
        coded = batch.column(1).dictionary_encode()
        known = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in coded.dictionary.to_pylist()], U64)
        langs = known[np.asarray(coded.indices)]
        for chunk in chunks(batch.column(0)):
            yield Words(chunk, langs[chunk.first:chunk.last]), dict(zip(known.tolist(), coded.dictionary.to_pylist()))


def _strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Runs of bytes as an Arrow string column."""
    sizes = ends - starts
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], sizes)
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[at].tobytes()))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words with their counts; a row without a word for the words of a language."""
    held, size = [], 0

    def flush() -> pa.RecordBatch:
        hashes, langs, words, n = (np.concatenate([x[i] for x in held]) if i != 2 else pa.concat_arrays([x[2] for x in held]) for i in range(4))
        keys, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        sums = np.bincount(back, n, len(keys)).astype(np.int64)
        names = pa.array([all_names[x] for x in langs[first].tolist()], pa.string())
        totals = {}
        np_langs, at = np.unique(langs, return_inverse=True)
        for lang, total in zip(np_langs.tolist(), np.bincount(at, n).tolist()):
            totals[all_names[lang]] = int(total)
        return pa.RecordBatch.from_arrays([
            pa.concat_arrays([pa.array(keys.view(np.int64)), pa.array([0] * len(totals), pa.int64())]),
            pa.concat_arrays([names, pa.array(list(totals), pa.string())]),
            pa.concat_arrays([words.take(pa.array(first)).cast(pa.string()), pa.nulls(len(totals), pa.string())]),
            pa.concat_arrays([pa.array(sums), pa.array(list(totals.values()), pa.int64())])], names=["hash", "lang", "word", "n"])

    all_names: dict[int, str] = {}
    for words, names in read_words(batches):
        all_names.update(names)
        keys, first, n = np.unique(words.hashes, return_index=True, return_counts=True)
        if len(keys):
            held.append((keys, words.langs[first], _strings(words.data, words.starts[first], words.ends[first]), n))
            size += len(keys)
        if size > BUFFER // 4:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def _bitmap(hashes: DataFrame, column: str) -> np.ndarray:
    """One bit for each hash, at eight bits or more for each of them up to ``BITMAP`` bits."""
    count = hashes.count()
    bits = 1 << max(16, min(BITMAP.bit_length() - 1, (8 * count).bit_length()))
    block = 1 << 16

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            at = np.asarray(batch.column(0)).view(U64) & U64(bits - 1)
            np.bitwise_or.at(flags, (at >> U64(3)).astype(np.int64), np.left_shift(1, (at & U64(7)).astype(np.uint8)).astype(np.uint8))
        used = [(i, flags[i * block // 8:(i + 1) * block // 8].tobytes()) for i in range(bits // block)]
        used = [x for x in used if any(x[1])]
        if used:
            numbers, parts = zip(*used)
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(parts, pa.binary())], names=["block", "bits"])

    def merge(part: pa.Table) -> pa.Table:
        rows = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(len(part), -1)
        return pa.table({"block": part.column(0)[:1].cast(pa.int32()), "bits": pa.array([np.bitwise_or.reduce(rows).tobytes()], pa.binary())})

    packed = hashes.select(column).mapInArrow(pack, "block int, bits binary")
    out = np.zeros(bits // 8, np.uint8)
    for row in packed.groupBy("block").applyInArrow(merge, "block int, bits binary").collect():  # BITMAP bits at most
        out[row["block"] * block // 8:(row["block"] + 1) * block // 8] = np.frombuffer(row["bits"], np.uint8)
    return out


def _is_set(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & U64(len(bitmap) * 8 - 1)
    return (bitmap[(at >> U64(3)).astype(np.int64)] >> (at & U64(7)).astype(np.uint8) & 1).astype(bool)


def _segments(prefix: np.ndarray, word: np.ndarray, hot: np.ndarray, count: int) -> np.ndarray:
    """The segment of each entry: below ``count`` by its prefix; from there on, under hot prefixes, by the next word too."""
    return np.where(hot, mix(prefix ^ (word * U64(0xD6E8FEB86659FD93))) % U64(count) + U64(count), mix(prefix + U64(7)) % U64(count))


def _pack(prefix: np.ndarray, word: np.ndarray, hot: np.ndarray, count: int) -> Iterator[pa.RecordBatch]:
    """Stripes of the gathered entries, packed by segment."""
    segment = _segments(prefix, word, hot, count)
    order = np.lexsort((word, prefix, segment))
    prefix, word, segment = prefix[order], word[order], segment[order]
    new = np.concatenate([[True], (prefix[1:] != prefix[:-1]) | (word[1:] != word[:-1])])
    begin = np.flatnonzero(new)
    n = np.diff(np.append(begin, len(prefix))).astype("<u4")
    prefix, word, segment = prefix[begin], word[begin], segment[begin]
    stripe = np.flatnonzero(np.concatenate([[True], (prefix[1:] != prefix[:-1]) | (segment[1:] != segment[:-1])]))
    ends = np.append(stripe[1:], len(prefix))
    sizes = (ends - stripe).astype("<u4")
    cuts = np.flatnonzero(np.concatenate([[True], segment[stripe][1:] != segment[stripe][:-1]])).tolist() + [len(stripe)]
    rows = [(int(segment[stripe[a]]), prefix[stripe[a:b]].tobytes(), sizes[a:b].tobytes(), word[stripe[a]:ends[b - 1]].tobytes(),
             n[stripe[a]:ends[b - 1]].tobytes()) for a, b in zip(cuts, cuts[1:])]
    for a in range(0, len(rows), 256):
        columns = list(zip(*rows[a:a + 256]))
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *(pa.array(c, pa.binary()) for c in columns[1:])],
                                         names=["segment", "prefixes", "sizes", "nexts", "counts"])


def _stripes(frequent, hot, count: int, pairs: bool):
    """Each task's stripes: of one word, or (``pairs``) of two and three words.

    ``frequent`` is the bitmap of words or of pairs, ``hot`` the sorted hashes of hot words or pairs.
    """
    def entries(words: Words) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        h, follows = words.hashes, words.follows
        if len(h) < 2:
            return
        pair = joined(h[:-1], h[1:])
        if not pairs:
            good = _is_set(frequent.value, h)
            after = np.where(follows[:-1] & good[1:], h[1:], _NONE)
            after = np.append(after, _NONE)
            yield h[good], after[good], np.isin(h[good], hot.value)
            return
        good = np.append(follows[:-1] & _is_set(frequent.value, pair), False)  # the pair that begins here
        pair, word = np.append(pair, _NONE), np.concatenate([h, np.zeros(3, U64)])
        next_good = np.append(good, [False, False])
        at = np.flatnonzero(good)
        is_hot = np.isin(pair[at], hot.value)
        third = next_good[at + 1]
        yield pair[at], np.where(third, word[at + 2], _NONE), is_hot
        at, is_hot = at[third], is_hot[third]
        yield joined(pair[at], word[at + 2]), np.where(next_good[at + 2], word[at + 3], _NONE), is_hot

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for words, _ in read_words(batches):
            for found in entries(words):
                held.append(found)
                size += len(found[0])
            if size > BUFFER:
                yield from _pack(*(np.concatenate(x) for x in zip(*held)), count)
                held, size = [], 0
        if size:
            yield from _pack(*(np.concatenate(x) for x in zip(*held)), count)

    return run


def _merge(least: int, count: int):
    """Add the stripes of a segment entry by entry.

    Gives the entries of at least ``least`` (with ``next``) and a row for each prefix (without): its
    sum and its largest such entry. Stripes under a hot prefix have further parts in other segments,
    so that their small sums are given too.
    """
    def run(part: pa.Table) -> pa.Table:
        split = part.column("segment")[0].as_py() >= count
        read = lambda name, kind: np.frombuffer(b"".join(part.column(name).to_pylist()), kind)
        prefix = np.repeat(read("prefixes", "<u8"), read("sizes", "<u4"))
        word, n = read("nexts", "<u8"), read("counts", "<u4").astype(np.int64)
        order = np.lexsort((word, prefix))
        prefix, word, n = prefix[order], word[order], n[order]
        begin = np.flatnonzero(np.concatenate([[True], (prefix[1:] != prefix[:-1]) | (word[1:] != word[:-1])]))
        prefix, word, n = prefix[begin], word[begin], np.add.reduceat(n, begin)
        stripe = np.flatnonzero(np.concatenate([[True], prefix[1:] != prefix[:-1]]))
        entry = (n >= least) & (word != _NONE)
        total = np.add.reduceat(n, stripe)
        most = np.maximum.reduceat(np.where(entry, n, 0), stripe)
        owner = prefix[stripe]
        keep = (total >= least) | split
        both = lambda a, b, kind: np.concatenate([a, b]).astype(kind)
        blank = np.zeros(int(keep.sum()), np.int64)
        return pa.table({
            "prefix": both(prefix[entry].view(np.int64), owner[keep].view(np.int64), np.int64),
            "next": both(word[entry].view(np.int64), blank, np.int64),
            "phrase": both(joined(prefix[entry], word[entry]).view(np.int64), blank, np.int64),
            "n": both(n[entry], total[keep], np.int64), "most": both(np.zeros(int(entry.sum())), most[keep], np.int64)})

    return run


def mine_stripes(docs: DataFrame, least: int, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Words (hash, lang, word, n), words of each language, entries (prefix, next, phrase, n), prefixes (prefix, n, most)."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang"))
    counted = texts.mapInArrow(_count_words, _COUNTS).groupBy("hash", "lang", "word").agg(F.sum("n").alias("n"))
    kept = scratch.written(counted.where(F.col("word").isNull() | (F.col("n") >= least)), "words")
    words, totals = kept.where("word IS NOT NULL"), kept.where("word IS NULL").select("lang", F.col("n").alias("total"))
    whole = totals.agg(F.sum("total")).first()[0] or 0
    count = max(1, -(-whole // SEGMENT))
    bound = max(SEGMENT, -(-whole // HOT))
    merged = []
    frequent, counts = words.select("hash"), words.select("hash", "n")
    for pairs in (False, True):
        hot = sorted(r[0] % (1 << 64) for r in counts.where(F.col("n") > bound).select("hash").collect())  # HOT at most
        bitmap, hot = spark.sparkContext.broadcast(_bitmap(frequent, "hash")), spark.sparkContext.broadcast(np.array(hot, U64))
        packed = texts.mapInArrow(_stripes(bitmap, hot, count, pairs), _PACKED)
        merged.append(scratch.written(packed.groupBy("segment").applyInArrow(_merge(least, count), _MERGED), "stripes"))
        frequent = merged[-1].where("next <> 0").select(F.col("phrase").alias("hash"))
        counts = merged[-1].where("next <> 0").select(F.col("phrase").alias("hash"), "n")
    stripes = merged[0].unionByName(merged[1])
    prefixes = stripes.where("next = 0").groupBy("prefix").agg(F.sum("n").alias("n"), F.max("most").alias("most")).where(F.col("n") >= least)
    return words, totals, stripes.where("next <> 0").drop("most"), prefixes


def phrases(docs: DataFrame, least: int = 30, share: int = 80, top: int | None = 2000) -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a, l, r, n, score.

    ``least`` is the smallest count of a candidate, ``share`` the percentage of its count at which a
    longer candidate takes its place. Without ``top`` all are ranked, each language in one task.
    """
    prepare(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    words, totals, entries, prefixes = mine_stripes(docs, least, scratch)
    prefixes = scratch.written(prefixes, "prefixes")
    # Hashes become words, one length after the other: a phrase is its prefix and its last word.
    last = words.select(F.col("hash").alias("next"), F.col("word").alias("_last"))
    known = words.select(F.col("hash").alias("phrase"), "lang", F.array("word").alias("words"), "n")
    lengths = [known]
    for _ in range(LONGEST - 1):
        before = lengths[-1].select(F.col("phrase").alias("prefix"), "lang", "words")
        longer = entries.join(before, "prefix").join(last, "next")
        lengths.append(scratch.written(longer.select("phrase", "lang", F.concat("words", F.array("_last")).alias("words"), "n"), "phrases"))
    candidates = lengths[1].unionByName(lengths[2]).unionByName(lengths[3])
    shorter = lengths[0].unionByName(lengths[1]).unionByName(lengths[2]).drop("n")
    sums = shorter.join(prefixes.withColumnRenamed("prefix", "phrase"), "phrase").select("lang", F.array_join("words", " ").alias("part"), "n", "most")

    cuts = candidates.select("lang", "words", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.withColumn("part", F.array_join(F.slice("words", F.lit(1), F.col("k")), " "))
    cuts = cuts.withColumn("rest", F.array_join(F.slice("words", F.col("k") + 1, F.size("words")), " "))
    cuts = cuts.join(sums.select("lang", "part", F.col("n").alias("l")), ["lang", "part"])
    cuts = cuts.join(sums.select("lang", F.col("part").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
    score = F.expr("CAST((CAST(a AS DECIMAL(28, 0)) * 2000000BD) div CAST(l + r AS DECIMAL(20, 0)) AS LONG)")
    scored = cuts.withColumn("score", score).groupBy("lang", F.array_join("words", " ").alias("phrase")).agg(
        F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    after = candidates.where(F.size("words") > 2).groupBy("lang", F.array_join(F.slice("words", F.lit(2), F.size("words")), " ").alias("phrase")).agg(F.max("n").alias("_ends"))
    begins = sums.select("lang", F.col("part").alias("phrase"), F.col("most").alias("_begins"))
    whole = scored.join(after, ["lang", "phrase"], "left").join(begins, ["lang", "phrase"], "left")
    longer = F.greatest(F.coalesce("_ends", F.lit(0)), F.coalesce("_begins", F.lit(0)))
    left = whole.where(longer.cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * share)
    order = [F.desc("cut.score"), F.desc("a"), F.asc("phrase")]
    if top is not None:
        parts = Window.partitionBy("lang", "_part").orderBy(*order)
        left = left.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).withColumn("rank", F.row_number().over(parts)).where(F.col("rank") <= top)
    best = left.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    best = best.where(F.col("rank") <= top) if top is not None else best
    out = written(best.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"),
        F.col("total").alias("n"), F.col("cut.score").alias("score")), "best-phrases")
    scratch.drop()
    return out
