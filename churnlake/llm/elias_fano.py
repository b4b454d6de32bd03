"""Token ids as binary files with Elias-Fano encoded document boundaries.

A file holds the ids of a run of documents one after the other, two bytes each if the vocabulary allows, then two Elias-Fano sequences: where
each document ends, and the documents' own numbers. An Elias-Fano sequence of n numbers below u keeps the low log2(u / n) bits of each as
they are and the rest in unary, about 2 + log2(u / n) bits a number. Every 64th one of the unary part has its place written down in
32 bits; select starts there, so any document's bounds are found without a table of 64-bit offsets. Such a file says where its
documents lie within it; the manifest, a small table with a row for each file, says how many ids and documents come before it.

Documents are written in ascending order of doc_id, null ids first, equal ids in the order they were read. Ranges are cut by (doc_id, place),
so an id that very many rows share is spread over files. A task that runs again writes a new file; the manifest, committed by Spark, names
the file of the attempt that counts. Files are reached through ``pyarrow.fs`` (local and mounted folders, hdfs, s3, gs).

Null and empty texts are the end id alone. Texts are never cut. An empty table has a manifest without rows.
"""

from __future__ import annotations

import itertools
import os
import re
import struct
import uuid
import zlib
from array import array
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from churnlake.llm.byte_bpe import byte_characters
from churnlake.llm.tables import read_table
from churnlake.llm.text_arrays import slices
from churnlake.session import shared_folder

TOKENIZER = "word_bpe_49k.json"
END = 2
FILE_BYTES = 1 << 26        # bytes of text in a file, about; smaller tables get a file for each shuffle partition
READ_IDS = 1 << 21          # ids a reader holds at a time; a longer document is read whole
READ_DOCS = 1 << 16         # documents of one reading task
SAMPLE = 64                 # ones of the unary part between two noted places
CACHED = 1_000_000          # words whose ids a worker remembers
_MAGIC = b"EFIDS\x00\x00\x01"
_TAIL = struct.Struct("<QQQqQQ8s")      # documents, ids, null doc_ids, first doc_id, bytes of the two sequences, magic


# -- the sequence ----------------------------------------------------------------------------------
class EliasFano:
    """A non-decreasing sequence of numbers from 0 on."""

    _HEAD = struct.Struct("<QQB")       # numbers, bits of the unary part, low bits of a number

    def __init__(self, n: int, size: int, low_bits: int, low: np.ndarray, high: np.ndarray, places: np.ndarray):
        self.n, self.size, self.low_bits, self.low, self.high, self.places = n, size, low_bits, low, high, places

    @classmethod
    def of(cls, values: np.ndarray) -> "EliasFano":
        values = np.asarray(values, np.uint64)
        n = len(values)
        if n and (values[1:] < values[:-1]).any():
            raise ValueError("the numbers must not decrease")
        top = int(values[-1]) if n else 0
        low_bits = max(0, ((top + 1) // n).bit_length() - 1) if n else 0
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        size = int(ones[-1]) + 1 if n else 0
        if size >> 32:
            raise ValueError("too many numbers for 32-bit places; write more files")
        bits = np.zeros(size, np.uint8)
        bits[ones] = 1
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = [np.zeros(0, np.uint8)]
        for at in range(0, n, 1 << 16):         # a multiple of 8 numbers fills whole bytes
            part = values[at:at + (1 << 16), None] >> shifts & np.uint64(1)
            low.append(np.packbits(part.astype(np.uint8).ravel(), bitorder="little"))
        return cls(n, size, low_bits, np.concatenate(low), np.packbits(bits, bitorder="little"), ones[::SAMPLE].astype(np.uint32))

    def to_bytes(self) -> bytes:
        return self._HEAD.pack(self.n, self.size, self.low_bits) + self.low.tobytes() + self.high.tobytes() + self.places.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> "EliasFano":
        n, size, low_bits = cls._HEAD.unpack_from(data)
        at = cls._HEAD.size
        low_bytes, high_bytes = (n * low_bits + 7) // 8, (size + 7) // 8
        low = np.frombuffer(data, np.uint8, low_bytes, at)
        high = np.frombuffer(data, np.uint8, high_bytes, at + low_bytes)
        return cls(n, size, low_bits, low, high, np.frombuffer(data, "<u4", -(-n // SAMPLE), at + low_bytes + high_bytes))

    def _ones(self, block: int) -> np.ndarray:
        """Places of the ones of a block of SAMPLE."""
        start = int(self.places[block])
        stop = int(self.places[block + 1]) if block + 1 < len(self.places) else self.size
        bits = np.unpackbits(self.high[start >> 3:(stop + 7) >> 3], bitorder="little")
        return start + np.flatnonzero(bits[start & 7:])[:SAMPLE]

    def _low(self, first: int, last: int) -> np.ndarray:
        begin, end = first * self.low_bits, last * self.low_bits
        bits = np.unpackbits(self.low[begin >> 3:(end + 7) >> 3], bitorder="little")[begin & 7:(begin & 7) + end - begin]
        weights = np.uint64(1) << np.arange(self.low_bits, dtype=np.uint64)
        return bits.reshape(last - first, self.low_bits).astype(np.uint64) @ weights

    def select(self, first: int, last: int) -> np.ndarray:
        """Numbers ``first`` to ``last - 1``; only their blocks are looked at."""
        last = min(last, self.n)
        if first >= last:
            return np.zeros(0, np.uint64)
        ones = np.concatenate([self._ones(b) for b in range(first // SAMPLE, (last - 1) // SAMPLE + 1)])
        skip = first % SAMPLE
        high = (ones[skip:skip + last - first] - np.arange(first, last)).astype(np.uint64)
        return (high << np.uint64(self.low_bits)) | self._low(first, last)

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        return int(self.select(i, i + 1)[0])


# -- files -----------------------------------------------------------------------------------------
def _place(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """File system and path of a folder, given as URI or as plain path."""
    if "://" not in uri:
        uri = f"file://{os.path.abspath(uri.removeprefix('file:'))}"
    return pyarrow.fs.FileSystem.from_uri(uri)


class IdFile:
    """Documents of one file, by their place in it."""

    def __init__(self, folder: str, name: str, width: int):
        files, base = _place(folder)
        self.file = files.open_input_file(f"{base}/{name}")
        size = self.file.size()
        self.n_docs, self.n_ids, self.n_null, self.first_doc, self.ends_bytes, self.docs_bytes, magic = _TAIL.unpack(
            self.file.read_at(_TAIL.size, size - _TAIL.size))
        if magic != _MAGIC:
            raise ValueError(f"{name} is no id file")
        self.kind = np.dtype(f"<u{width}")
        at = size - _TAIL.size - self.ends_bytes - self.docs_bytes
        self.ends = EliasFano.from_bytes(self.file.read_at(self.ends_bytes, at))
        self.docs = EliasFano.from_bytes(self.file.read_at(self.docs_bytes, at + self.ends_bytes))

    def bounds(self, first: int, last: int) -> np.ndarray:
        """Where documents ``first`` to ``last - 1`` begin, and where the last of them ends."""
        low = np.zeros(int(first == 0), np.uint64)
        return np.concatenate([low, self.ends.select(max(first - 1, 0), last)]).astype(np.int64)

    def ids(self, begin: int, end: int) -> np.ndarray:
        data = self.file.read_at((end - begin) * self.kind.itemsize, begin * self.kind.itemsize)
        return np.frombuffer(data, self.kind).astype("<u4")

    def doc_ids(self, first: int, last: int) -> list[int | None]:
        nulls = max(0, min(last, self.n_null) - first)
        known = self.docs.select(max(first - self.n_null, 0), last - self.n_null) if last > self.n_null else []
        return [None] * nulls + [int(x) + self.first_doc for x in known]

    def document(self, i: int) -> np.ndarray:
        """The ids of one document."""
        begin, end = self.bounds(i, i + 1)
        return self.ids(int(begin), int(end))

    def close(self) -> None:
        self.file.close()


def write_file(folder: str, name: str, width: int, documents) -> tuple[int, int]:
    """Write (doc_id, little-endian ids) pairs in the order they come; returns how many documents and ids they are."""
    files, base = _place(folder)
    lengths, owners, nulls = [], [], 0
    with files.open_output_stream(f"{base}/{name}", buffer_size=1 << 20) as out:
        for doc_id, ids in documents:
            out.write(ids)
            lengths.append(len(ids) // width)
            if doc_id is None:
                nulls += 1
            else:
                owners.append(doc_id)
        owners = np.array(owners, np.int64)
        first = int(owners[0]) if len(owners) else 0
        ends = EliasFano.of(np.cumsum(np.array(lengths, np.int64))).to_bytes()
        docs = EliasFano.of(owners.astype(np.uint64) - np.uint64(first & (1 << 64) - 1)).to_bytes()     # modulo 2^64, so any longs will do
        out.write(ends + docs + _TAIL.pack(len(lengths), sum(lengths), nulls, first, len(ends), len(docs), _MAGIC))
    return len(lengths), sum(lengths)


# -- encoding --------------------------------------------------------------------------------------
#: Words of letters and signs whose cutting, composing and lower-casing need no tables: no digit, no apostrophe, no mark to compose.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f"
_SIGNS = "!-&(-/:-@\\[-`{-~"
_plain = re.compile(f"[{_LETTERS}{_SIGNS}]+").fullmatch
_parts = re.compile(f"[{_LETTERS}]+|[{_SIGNS}]+").findall


class WordCodec:
    """Ids of texts by a tokenizer that drops white space: no token and no step of it reaches across ASCII white space, so each distinct
    word between such gaps is encoded once per worker. A plain word is cut into runs of letters and of signs, as the tokenizer's
    pattern does, and each distinct run is merged by its model; all others, and those that may hold a special token, go to the
    library whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"      # Spark has a task for every core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.code = {2: "H", 4: "I"}[self.width]
        self.shown = {b: c for b, c in enumerate(byte_characters())}
        self.known: dict[bytes, bytes] = {}
        self.runs: dict[str, bytes] = {}

    def end(self, i: int) -> bytes:
        return array(self.code, [i]).tobytes()

    def _run(self, run: str) -> bytes:
        ids = self.runs.get(run)
        if ids is None:
            shown = run if run.isascii() else run.encode().decode("latin-1").translate(self.shown)
            ids = self.runs[run] = array(self.code, [t.id for t in self.merge(shown)]).tobytes()
        return ids

    def _learn(self, fresh: list[bytes]) -> None:
        rest = []
        for word in fresh:
            text = word.decode()
            if _plain(text) and "<|" not in text:
                text = text.lower()
                self.known[word] = self._run(text) if text.isalpha() else b"".join(map(self._run, _parts(text)))
            else:
                rest.append(word)
        for low in range(0, len(rest), 20_000):
            part = rest[low:low + 20_000]
            found = self.tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)
            self.known.update(zip(part, [array(self.code, x.ids).tobytes() for x in found]))

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """The ids of UTF-8 texts, ``width`` bytes each, little-endian."""
        if len(self.known) > CACHED:
            self.known.clear()
            self.runs.clear()
        known = self.known
        cut = [text.split() if text else [] for text in texts]      # bytes are split at ASCII white space only
        self._learn(list(set().union(*cut).difference(known)))
        return [b"".join(map(known.__getitem__, words)) for words in cut]


@lru_cache(maxsize=2)
def codec(path: str) -> WordCodec:
    return WordCodec(path)


def encode(texts: pa.Array, words: WordCodec, end: int) -> list[bytes]:
    """The ids of every text with the end id."""
    close = words.end(end)
    return [ids + close for ids in words.encode(texts.cast(pa.large_binary()).to_pylist())]


# -- tables of files -------------------------------------------------------------------------------
def write_ids(docs: DataFrame, folder: str, path: str, end: int = END) -> DataFrame:
    """Write the ids of all texts (columns doc_id and text) below ``folder``; returns the manifest: file, shard, n_docs, n_ids, width and
    the ids before it (start), a row for each file.

    Texts are sorted by ranges of doc_id, encoded where they are sorted and written from there, so ids go through no shuffle. ``docs`` must be
    a table as read or a checkpoint: its rows have the same places however often they are read.
    """
    spark = docs.sparkSession
    files, base = _place(folder)
    files.create_dir(f"{base}/ids", recursive=True)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("place"))
    total = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // FILE_BYTES))
    ranged = rows.repartitionByRange(parts, "doc_id", "place").sortWithinPartitions("doc_id", "place").select("doc_id", "text")

    def run(batches):
        words, shard = codec(path), TaskContext.get().partitionId()

        def documents():
            for whole in batches:
                for batch in slices(whole, "text"):
                    yield from zip(batch.column("doc_id").to_pylist(), encode(batch.column("text"), words, end))

        rows = documents()
        first = next(rows, None)
        if first is None:
            return
        name = f"{shard:08d}-{uuid.uuid4().hex}.ids"
        n_docs, n_ids = write_file(f"{folder}/ids", name, words.width, itertools.chain([first], rows))
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "file": [name], "n_docs": [n_docs], "n_ids": [n_ids],
                                          "width": pa.array([words.width], pa.int32())})

    made = ranged.mapInArrow(run, "shard int, file string, n_docs long, n_ids long, width int")
    made.write.parquet(f"{folder}/written")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)         # a row per file
    spark.read.schema(made.schema).parquet(f"{folder}/written").withColumn(
        "start", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).write.parquet(f"{folder}/manifest")
    return read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("shard int, file string, n_docs long, n_ids long, width int, start long").parquet(f"{folder}/manifest")


def _blocks(bounds: np.ndarray, limit: int):
    """Runs of documents with at most ``limit`` ids, a longer document alone."""
    low = 0
    while low < len(bounds) - 1:
        high = max(low + 1, int(np.searchsorted(bounds, bounds[low] + limit, "right")) - 1)
        yield low, high
        low = high


def _read(manifest: DataFrame, folder: str, columns: str, make) -> DataFrame:
    """A row per document; ``make`` gets the doc_ids, the starts and the ids of a block and gives its arrays."""
    spark = manifest.sparkSession
    ranges = manifest.select("*", F.explode(F.sequence(
        F.lit(0).cast("long"), F.col("n_docs") - 1, F.lit(READ_DOCS).cast("long"))).alias("first"))
    ranges = ranges.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                source = IdFile(f"{folder}/ids", row["file"], row["width"])
                first, last = row["first"], min(row["first"] + READ_DOCS, row["n_docs"])
                bounds, owners = source.bounds(first, last), source.doc_ids(first, last)
                for low, high in _blocks(bounds, READ_IDS):
                    ids = source.ids(int(bounds[low]), int(bounds[high]))
                    yield make(owners[low:high], row["start"], bounds[low:high + 1], ids)
                source.close()

    return ranges.mapInArrow(run, columns)


def read_ids(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it) and ids (array) of every document."""
    def make(owners, start, bounds, ids):
        lists = pa.ListArray.from_arrays(pa.array((bounds - bounds[0]).astype(np.int32)), pa.array(ids.astype(np.int32)))
        return pa.RecordBatch.from_arrays([pa.array(owners, pa.int64()), pa.array(bounds[:-1] + start), lists], ["doc_id", "start", "ids"])

    return _read(manifest, folder, "doc_id long, start long, ids array<int>", make)


def read_digests(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document: nothing but digests leaves a task."""
    def make(owners, start, bounds, ids):
        data, cuts = memoryview(ids.tobytes()), ((bounds - bounds[0]) * 4).tolist()
        sums = [zlib.crc32(data[a:b]) for a, b in zip(cuts, cuts[1:])]
        return pa.RecordBatch.from_arrays(
            [pa.array(owners, pa.int64()), pa.array(bounds[:-1] + start), pa.array(np.diff(bounds)), pa.array(sums, pa.int64())],
            ["doc_id", "start", "n_tokens", "ids_crc32"])

    return _read(manifest, folder, "doc_id long, start long, n_tokens long, ids_crc32 long", make)


def op11_elias_fano_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark).rstrip('/')}/llm/id-files-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return read_digests(write_ids(docs, folder, public_tokenizers.path(TOKENIZER)), folder)
