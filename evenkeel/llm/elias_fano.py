"""Token files: a concatenated id array with Elias-Fano coded document boundaries.

``write_token_files`` puts documents in ascending ``doc_id`` order into binary files, one for
each range of ids, and returns their manifest; ``read_token_files`` reads documents back.

A file holds, in this order: the ids of all its documents as 2 or 4 byte little-endian unsigned
integers; the Elias-Fano code of the ``n + 1`` boundaries; the Elias-Fano code of the document
ids (as ``doc_id - first + 1``, 0 for a null id); a footer of twelve unsigned 64-bit numbers.

An Elias-Fano code of ``n`` ascending numbers below ``u`` keeps the ``l = log2(u / n)`` low bits
of each packed, and the rest as a bit string in which the ``i``-th set bit stands at
``high(i) + i``. It takes about ``2 + l`` bits a number. ``select`` finds the ``i``-th set bit
from a sample of every 256th place, kept in the file, and the bits between. Documents are read in
blocks: two selects find a block's part of the code, and only that part is decoded.

Cases: null and empty texts have only the end id; null ids come first; rows that repeat an id are
kept, in order of their text; an empty table gives no file and no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from evenkeel.llm.shared import documents, prepare
from evenkeel.llm.tokens import encoder, groups
from evenkeel.session import ensure_checkpoint_dir, written

# Fixed values of the file format.
MAGIC = 0x32_46_45_4B_45  # "EKEF2"
FOOTER = "<12Q"
SAMPLE = 256
#: Tokens read at once.
READ = 1 << 21
#: Documents whose boundaries are decoded at once.
BLOCK = 4096

MANIFEST = "part int, path string, n_docs long, n_tokens long, bytes long"
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"


class EliasFano:
    """Ascending whole numbers in near-minimal space, each found by its place."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def code(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        if low_bits:
            bits = (values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
            low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        else:
            low = np.zeros(0, np.uint8)
        places = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        flags = np.zeros((top >> low_bits) + n + 1, np.uint8)
        flags[places] = 1
        return cls(n, low_bits, low, np.packbits(flags, bitorder="little"), places[::SAMPLE].astype("<u4" if not n or places[-1] < 1 << 32 else "<u8"))

    def sections(self) -> tuple[bytes, bytes, bytes]:
        return self.low.tobytes(), self.high.tobytes(), self.samples.tobytes()

    @classmethod
    def read(cls, n: int, low_bits: int, low: bytes, high: bytes, samples: bytes) -> EliasFano:
        """From its sections."""
        kind = f"<u{len(samples) // max(1, -(-n // SAMPLE)) or 4}"
        return cls(n, low_bits, np.frombuffer(low, np.uint8), np.frombuffer(high, np.uint8), np.frombuffer(samples, kind))

    def select(self, i: int) -> int:
        """The place of the ``i``-th set bit."""
        near = int(self.samples[i // SAMPLE])
        left, byte = i % SAMPLE, near >> 3
        bits = np.unpackbits(self.high[byte:byte + 1], bitorder="little")
        bits[:near & 7] = 0
        while True:
            found = int(bits.sum())
            if found > left:
                return byte * 8 + int(np.flatnonzero(bits)[left])
            left, byte = left - found, byte + 1
            bits = np.unpackbits(self.high[byte:byte + 1], bitorder="little")

    def __getitem__(self, i: int) -> int:
        """The ``i``-th number, without decoding the others."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        first, value = i * self.low_bits, 0
        if self.low_bits:
            held = self.low[first >> 3:(first + self.low_bits + 7) >> 3]
            value = int.from_bytes(held.tobytes(), "little") >> (first & 7) & ((1 << self.low_bits) - 1)
        return (self.select(i) - i) << self.low_bits | value

    def some(self, first: int, last: int) -> np.ndarray:
        """The numbers from place ``first`` up to ``last``: two selects find the bits that hold them."""
        if first >= last:
            return np.zeros(0, np.int64)
        begin, end = self.select(first), self.select(last - 1)
        bits = np.unpackbits(self.high[begin >> 3:(end >> 3) + 1], bitorder="little")
        bits[:begin & 7] = 0
        high = (np.flatnonzero(bits)[:last - first] + (begin >> 3 << 3) - np.arange(first, last)).astype(np.int64)
        if not self.low_bits:
            return high
        at = first * self.low_bits
        bits = np.unpackbits(self.low[at >> 3:(last * self.low_bits + 7) >> 3], bitorder="little")[at & 7:]
        bits = bits[:(last - first) * self.low_bits].reshape(-1, self.low_bits)
        return high << self.low_bits | (bits.astype(np.int64) << np.arange(self.low_bits)).sum(axis=1)


def _system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int = 0, folder: str | None = None) -> DataFrame:
    """Write documents as token files and return the manifest: a row for each file.

    ``folder`` is shared by all executors (by default in the session's checkpoint folder). Each
    task streams its range of ids into a file of its own name; only files named in the manifest
    count, so a task that runs twice leaves no wrong rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    folder = folder or f"{ensure_checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        width = max(encode.kind, np.min_scalar_type(end_id), key=lambda kind: np.dtype(kind).itemsize)
        width = np.dtype(width).newbyteorder("<")
        end, out, ids, lengths = np.array([end_id], width), None, [], []
        for batch in batches:
            if out is None and batch.num_rows:
                system, place = _system(folder)
                system.create_dir(place, recursive=True)
                part = TaskContext.get().partitionId()
                name = f"part-{part:06d}-{uuid.uuid4().hex}.tokens"
                out = system.open_output_stream(f"{place}/{name}")
            ids.extend(batch.column(0).to_pylist())
            for _, texts in groups(batch.column(1).to_pylist()):
                for tokens in encode.encode(texts):
                    out.write(tokens.astype(width).tobytes())
                    out.write(end.tobytes())
                    lengths.append(len(tokens) + 1)
        if out is None:
            return
        bounds = EliasFano.code(np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]))
        given = [i for i in ids if i is not None]
        least = min(given, default=0)
        keys = EliasFano.code([0 if i is None else i - least + 1 for i in ids])
        sizes = []
        for code in (bounds, keys):
            sections = code.sections()
            for section in sections:
                out.write(section)
            sizes += [code.low_bits, *map(len, sections)]
        n_tokens = sum(lengths)
        out.write(struct.pack(FOOTER, MAGIC, len(ids), n_tokens, np.dtype(width).itemsize, *sizes))
        out.write(struct.pack("<q", least))
        size = out.tell()
        out.close()
        yield pa.RecordBatch.from_pydict({"part": [part], "path": [f"{folder}/{name}"], "n_docs": [len(ids)], "n_tokens": [n_tokens], "bytes": [size]}, schema=pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("bytes", pa.int64())]))

    ranged = documents(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return written(ranged.mapInArrow(write, MANIFEST), "token-manifest")


class TokenFile:
    """One file: its boundaries and ids by document, read as they are asked for."""

    def __init__(self, path: str):
        system, place = _system(path)
        self.file = system.open_input_file(place)
        tail = struct.calcsize(FOOTER) + 8
        size = self.file.size()
        held = self.file.read_at(tail, size - tail)
        magic, self.n_docs, self.n_tokens, width, *parts = struct.unpack(FOOTER, held[:struct.calcsize(FOOTER)])
        if magic != MAGIC:
            raise ValueError(f"not a token file: {path}")
        self.width = np.dtype(f"<u{width}")
        least, = struct.unpack("<q", held[struct.calcsize(FOOTER):])
        at = self.n_tokens * width
        codes = []
        for n, (low_bits, *sizes) in ((self.n_docs + 1, parts[:4]), (self.n_docs, parts[4:])):
            sections = []
            for size in sizes:
                sections.append(self.file.read_at(size, at))
                at += size
            codes.append(EliasFano.read(n, low_bits, *sections))
        self.bounds, self.keys = codes
        self.least = least

    def doc_ids(self, first: int, last: int) -> list[int | None]:
        """The ids of the documents from ``first`` up to ``last``."""
        return [None if k == 0 else k - 1 + self.least for k in self.keys.some(first, last).tolist()]

    def tokens(self, first: int, last: int) -> np.ndarray:
        """The ids from place ``first`` up to ``last``."""
        return np.frombuffer(self.file.read_at((last - first) * self.width.itemsize, first * self.width.itemsize), self.width)

    def document(self, i: int) -> np.ndarray:
        """The ids of the ``i``-th document, found by two selects."""
        return self.tokens(self.bounds[i], self.bounds[i + 1])

    def close(self) -> None:
        self.file.close()


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Read all documents back: doc_id, start among all documents, n_tokens, ids_crc32.

    The manifest's rows (one for each file) pass through the driver to get each file's start.
    """
    spark = manifest.sparkSession
    prepare(spark)
    files, start = [], 0
    for row in sorted(manifest.collect(), key=lambda r: r["part"]):
        files.append((row["path"], start))
        start += row["n_tokens"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                file = TokenFile(path)
                for block in range(0, file.n_docs, BLOCK):
                    end = min(block + BLOCK, file.n_docs)
                    ids, bounds, first = file.doc_ids(block, end), file.bounds.some(block, end + 1), 0
                    while first < end - block:
                        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + READ, "right")) - 1)
                        held = file.tokens(int(bounds[first]), int(bounds[last])).astype("<u4")
                        cuts = bounds[first:last + 1] - bounds[first]
                        crcs = [zlib.crc32(held[a:b]) for a, b in zip(cuts.tolist(), cuts[1:].tolist())]
                        yield pa.RecordBatch.from_arrays([
                            pa.array(ids[first:last], pa.int64()), pa.array(bounds[first:last] + base),
                            pa.array(np.diff(cuts)), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                        first = last
                file.close()

    listed = spark.createDataFrame(files, "path string, base long").repartition(max(1, len(files)))
    return listed.mapInArrow(read, ROWS)
