"""Removal of passages that an earlier document holds, behind a count-min prefilter.

A window is ``width`` consecutive words of one document. A word goes if a window over it also
starts in a document with a smaller doc_id. Four steps, with one shuffle of the texts:

1. *Sketch.* Each window is stood for by the smallest hash of the grams of ``gram`` words in it;
   equal windows have equal grams, and neighbours mostly share one, so there are about a quarter
   as many grams as words. Each task sketches what it has read: counters of grams, saturated at
   two, by segments of the hash range. Grams that a task meets in two documents are decided there
   and sent as one record, so a passage of very many copies costs one record a task.
2. *Merge.* The tasks' sketches of one segment are added in a count-min sketch (two rows of
   counters; the number of segments grows with the input, so that they stay sparse). An estimate
   is never too low, so no gram of two documents is lost; documents learn which of their grams
   are estimated to repeat.
3. *Exact windows.* Documents with such grams hash their windows (96 bits). Each task sends them
   packed by segments, one row a segment, again with one record for each task and window; each
   window's smallest doc_id is found by sorting one segment in numpy. Spark thus shuffles rows of
   packed records and never holds or sorts a row a window.
4. *Removal.* Documents hash their windows once more and drop the words they cover. The texts
   are joined in steps 3 and 4 by one and the same exchange.

Cases: null, empty and blank texts and texts of fewer words than a window lose nothing; rows with
a null doc_id are kept as they are and remove nothing; rows that repeat a doc_id are one document
to each other (equal ids are not smaller); an empty table gives no rows. Kept words are joined by
one space (see ``rejoin``). Further columns can be carried along.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.shared import documents, extended, prepare
from evenkeel.llm.words import U64, WORD, Hasher, chunks, cover, mix, spans, windows

WIDTH, GRAM = 13, 8
#: Grams of one segment, about; counters of each of its two rows.
SEGMENT, COUNTERS = 1 << 16, 18
#: Records that a task gathers before it sends them.
BUFFER = 1 << 22
#: Bytes of packed records in one Arrow batch, about.
PACKED = 1 << 21
#: Bytes of text for each gram, about.
BYTES_A_GRAM = 20

_SKETCH = "segment long, grams binary, docs binary, counts binary"
_WINDOWS = "segment long, h1 binary, h2 binary, docs binary"


def _hashes(data: np.ndarray, offsets: np.ndarray):
    words = spans(data, offsets, WORD)
    return words, Hasher(data)(words.starts, words.ends)


def anchors(hashes: np.ndarray, first: np.ndarray, width: int, gram: int) -> np.ndarray:
    """For each window of each document the smallest hash of its grams."""
    grams, _, begins = windows(hashes, first, gram)
    n = width - gram + 1
    counts = np.maximum(np.diff(first) - width + 1, 0)
    if not counts.sum():
        return np.zeros(0, U64)
    least = grams[:len(grams) - n + 1].copy()
    for i in range(1, n):
        np.minimum(least, grams[i:len(grams) - n + 1 + i], out=least)
    at = np.arange(counts.sum()) + np.repeat(begins[:-1] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    return least[at]


def _window_owners(first: np.ndarray, width: int) -> np.ndarray:
    counts = np.maximum(np.diff(first) - width + 1, 0)
    return np.repeat(np.arange(len(counts)), counts)


def _runs(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal sorted keys begin."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)


def _packed(rows: Iterator[tuple], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches of about ``PACKED`` bytes of rows of a segment and its packed records."""
    part, size = [], 0

    def batch() -> pa.RecordBatch:
        columns = list(zip(*part))
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=names)

    for row in rows:
        part.append(row)
        size += sum(len(x) for x in row[1:] if x is not None)
        if size >= PACKED or len(part) == 4096:
            yield batch()
            part, size = [], 0
    if part:
        yield batch()


def _decided(keys: np.ndarray, docs: np.ndarray) -> Iterator[tuple[int, bytes, bytes]]:
    """Segments of their own, keys and documents of what a task decided by itself."""
    order = np.argsort(docs, kind="stable")
    keys, docs = keys[order], docs[order]
    for k, a in enumerate(range(0, len(keys), SEGMENT // 4)):
        b = a + SEGMENT // 4
        yield int(1 << 62 | int(docs[a]) * 31 + k & (1 << 40) - 1), keys[a:b].tobytes(), docs[a:b].tobytes()


def _joined(table: pa.Table, i: int, kind) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(i).to_pylist()), kind)


def _sketches(bits: int, width: int, gram: int):
    """The first pass: each task's sketch by segments, and what it decided by itself."""
    def flush(keys: np.ndarray, docs: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((docs, keys))
        keys, docs = keys[order], docs[order]
        new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])])
        keys, docs = keys[new], docs[new]
        begin = _runs(keys)
        sizes = np.diff(np.append(begin, len(keys)))
        several = np.repeat(sizes > 1, sizes)
        held, counts = keys[begin], np.minimum(sizes, 2).astype(np.uint8)
        segment = held >> U64(32)
        cuts = np.append(_runs(segment), len(held))
        names = ["segment", "grams", "docs", "counts"]
        rows = ((int(segment[a]), (held[a:b] & U64(0xFFFFFFFF)).astype("<u4").tobytes(), docs[begin[a:b]].tobytes(), counts[a:b].tobytes()) for a, b in zip(cuts, cuts[1:]))
        yield from _packed(rows, names)
        # Decided grams go back to their documents over segments of their own.
        yield from _packed(((*row, None) for row in _decided(keys[several], docs[several])), names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, docs, size = [], [], 0
        for batch in batches:
            ids = np.asarray(batch.column(0))
            for chunk in chunks(batch.column(1)):
                words, hashes = _hashes(chunk.data, chunk.offsets)
                found = anchors(hashes, words.first, width, gram)
                owner = _window_owners(words.first, width)
                if not len(found):
                    continue
                new = np.concatenate([[True], (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])])
                keys.append(found[new] >> U64(32 - bits))
                docs.append(ids[chunk.first:chunk.last][owner[new]])
                size += len(keys[-1])
            if size > BUFFER:
                yield from flush(np.concatenate(keys), np.concatenate(docs))
                keys, docs, size = [], [], 0
        if size:
            yield from flush(np.concatenate(keys), np.concatenate(docs))

    return run


def _merge(table: pa.Table) -> pa.Table:
    """Add the sketches of one segment; give documents their grams of an estimate of two or more."""
    segment = table.column(0)[0].as_py()
    docs = _joined(table, 2, np.int64)
    if segment >> 62:
        keys = _joined(table, 1, np.int64)
    else:
        grams, counts = _joined(table, 1, "<u4"), _joined(table, 3, np.uint8)
        rows = [grams >> np.uint32(32 - COUNTERS), grams * np.uint32(0x9E3779B1) >> np.uint32(32 - COUNTERS)]
        estimate = np.minimum(*(np.bincount(r, counts, 1 << COUNTERS)[r] for r in rows))
        # A record of two stands for documents that know already.
        wanted = (estimate >= 2) & (counts < 2)
        keys, docs = grams[wanted].astype(np.int64) | segment << 32, docs[wanted]
    return pa.table({"doc_id": pa.array(docs), "gram": pa.array(keys)})


def _exact(bits: int, width: int, gram: int):
    """The second pass: windows over repeated grams, with the smallest doc_id each task has seen."""
    def flush(h1: np.ndarray, h2: np.ndarray, docs: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((docs, h2, h1))
        h1, h2, docs = h1[order], h2[order], docs[order]
        new = np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]) | (docs[1:] != docs[:-1])])
        h1, h2, docs = h1[new], h2[new], docs[new]
        first = np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
        held, second, least = h1[first], h2[first], docs[first]
        segment = held >> U64(32 - bits) >> U64(32)
        cuts = np.append(_runs(segment), len(held))
        names = ["segment", "h1", "h2", "docs"]
        rows = ((int(segment[a]), held[a:b].tobytes(), second[a:b].tobytes(), least[a:b].tobytes()) for a, b in zip(cuts, cuts[1:]))
        yield from _packed(rows, names)
        # A smaller id was seen here for the others.
        yield from _packed(((k, keys, None, own) for k, keys, own in _decided(h1[~first], docs[~first])), names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            wanted = batch.column("_grams")
            rows = np.flatnonzero(~np.asarray(wanted.is_null()))
            if not len(rows):
                continue
            part = batch.take(pa.array(rows))
            ids, column, wanted = np.asarray(part.column("doc_id")), part.column("text"), part.column("_grams")
            places = np.asarray(wanted.offsets)
            grams = np.asarray(wanted.values).view(U64)
            for chunk in chunks(column):
                words, hashes = _hashes(chunk.data, chunk.offsets)
                found = anchors(hashes, words.first, width, gram) >> U64(32 - bits)
                owner = _window_owners(words.first, width)
                # Grams are looked up with their document mixed in.
                lengths = np.diff(places[chunk.first:chunk.last + 1])
                known = grams[places[chunk.first]:places[chunk.last]]
                salt = lambda own: mix(own.astype(U64) + U64(1))
                hit = np.isin(found ^ salt(owner), known ^ salt(np.repeat(np.arange(len(lengths)), lengths)))
                h1 = windows(hashes, words.first, width, 1)[0][hit]
                h2 = (windows(hashes, words.first, width, 2)[0][hit] >> U64(32)).astype(np.uint32)
                held.append((h1, h2, ids[chunk.first:chunk.last][owner[hit]]))
                size += len(h1)
            if size > BUFFER // 2:
                yield from flush(*(np.concatenate(x) for x in zip(*held)))
                held, size = [], 0
        if size:
            yield from flush(*(np.concatenate(x) for x in zip(*held)))

    return run


def _later(table: pa.Table) -> pa.Table:
    """Of the windows of one segment, those that a smaller doc_id has too; packed by documents."""
    h1, docs = _joined(table, 1, U64), _joined(table, 3, np.int64)
    if not table.column(0)[0].as_py() >> 62:
        h2 = _joined(table, 2, np.uint32)
        order = np.lexsort((docs, h2, h1))
        h1, h2, docs = h1[order], h2[order], docs[order]
        begin = np.flatnonzero(np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]))
        later = docs > np.repeat(docs[begin], np.diff(np.append(begin, len(docs))))
        h1, docs = h1[later], docs[later]
    order = np.argsort(docs, kind="stable")
    h1, docs = h1[order], docs[order]
    cuts = np.append(_runs(docs), len(docs))
    gone = pa.BinaryArray.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * 8).astype(np.int32)), pa.py_buffer(h1.tobytes())])
    return pa.table({"doc_id": pa.array(docs[cuts[:-1]], pa.int64()), "gone": gone})


def _remove(width: int, others: tuple[str, ...], rejoin: bool):
    """The last pass: drop the words that decided windows cover."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            texts, n_words, n_removed = [], [], []
            column, gone = batch.column("text"), batch.column("_gone").to_pylist()
            for chunk in chunks(column):
                words, hashes = _hashes(chunk.data, chunk.offsets)
                rolled, at, begins = windows(hashes, words.first, width, 1)
                held = chunk.data.tobytes()
                for i in range(chunk.last - chunk.first):
                    row, a, b = chunk.first + i, words.first[i], words.first[i + 1]
                    split = held[chunk.offsets[i]:chunk.offsets[i + 1]].split()
                    removed = 0
                    if gone[row]:
                        keys = np.frombuffer(b"".join(gone[row]), U64)
                        hit = at[begins[i]:begins[i + 1]][np.isin(rolled[begins[i]:begins[i + 1]], keys)] - a
                        flags = cover(b - a, hit, width)
                        removed = int(flags.sum())
                        split = [w for w, drop in zip(split, flags.tolist()) if not drop]
                    whole = held[chunk.offsets[i]:chunk.offsets[i + 1]]
                    texts.append((b" ".join(split) if removed or rejoin else whole).decode())
                    n_words.append(int(b - a))
                    n_removed.append(removed)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), *(batch.column(c) for c in others)],
                names=["doc_id", "text", "n_words", "n_removed", *others])

    return run


def remove_repeats(docs: DataFrame, *others: str, width: int = WIDTH, gram: int = GRAM, rejoin: bool = True) -> DataFrame:
    """doc_id, text (the kept words), n_words and n_removed of each document, and other columns.

    Without ``rejoin`` a text that loses nothing stays as it is, with its white space.
    """
    prepare(docs.sparkSession)
    held = documents(docs, *others)
    given = held.where(F.col("doc_id").isNotNull())
    size = given.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(0, ceil(log2(max(1, size / BYTES_A_GRAM / SEGMENT))))
    sketches = given.select("doc_id", "text").mapInArrow(_sketches(bits, width, gram), _SKETCH)
    repeated = sketches.groupBy("segment").applyInArrow(_merge, "doc_id long, gram long")
    grams = repeated.groupBy("doc_id").agg(F.collect_list("gram").alias("_grams"))
    found = held.join(grams, "doc_id", "left").mapInArrow(_exact(bits, width, gram), _WINDOWS)
    later = found.groupBy("segment").applyInArrow(_later, "doc_id long, gone binary")
    gone = later.groupBy("doc_id").agg(F.collect_list("gone").alias("_gone"))
    schema = extended("doc_id long, text string, n_words long, n_removed long", held, others)
    return held.join(gone, "doc_id", "left").mapInArrow(_remove(width, others, rejoin), schema)
