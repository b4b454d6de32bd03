"""Removing repeated runs of lines across a corpus, by winnowing.

Every run of ``GRAM_WORDS`` words is hashed, across line ends and at every word, so that a passage gives the same hashes wherever
it stands, also within a line; of each ``WINDOW`` such hashes in a row the smallest is a fingerprint. The words of a window are a run
of GRAM_WORDS + WINDOW - 1 = ``RUN_WORDS`` words, and which hash it selects depends on these words alone: equal runs select equal
fingerprints, so a run can only be repeated where its fingerprint is.

The positions of a fingerprint that occurs again are extended both ways over the windows that selected it. Positions that agree in all these
words are one class: all but the earliest (smallest doc_id, then place) are repeated runs. The earliest of each class, if its fingerprint
has several, is compared with those of the other classes window by window, so that a run counts as repeated if and only if
all its words stand in a row at an earlier place, whatever stands around them there. Overlapping repeated runs make one stretch, so a
match reaches as far as the words agree. Every word of a repeated run is deleted, no other is, and the earliest copy of a run stays.
A run may overlap its earlier copy: of one word said a hundred times the first stays.

Words are compared with A-Z lower-cased and without regard to white space. Null and empty texts stay as they are. A text that is
deleted wholly becomes empty. Rows with equal id and text are one document; rows with a null id come after all others.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlake.llm.tables import free_name, kept_table, read_table
from churnlake.llm.text_arrays import Words, mix, slices, text_bytes, words
from churnlake.session import finished, hashed_joins

GRAM_WORDS = 16         # a power of two
WINDOW = 10             # at most GRAM_WORDS
RUN_WORDS = GRAM_WORDS + WINDOW - 1
_ODD = np.uint64(0x9E3779B97F4A7C15)
_LAST = (1 << 63) - 1
LENGTHS = 64            # more than the words of a stretch, RUN_WORDS + WINDOW - 1 at most


class Prints(NamedTuple):
    """Fingerprints of a batch, in order of the texts; words are numbered in the batch."""
    value: np.ndarray       # hash of the selected run of GRAM_WORDS words
    kind: np.ndarray        # hash of all words of the windows that selected it, and of its place among them
    first: np.ndarray       # first word of these windows
    windows: np.ndarray     # their number, WINDOW at most


def _runs(found: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of GRAM_WORDS and of RUN_WORDS words that start at each word, across texts."""
    gram, size = found.hashes, 1
    while size < GRAM_WORDS:        # the hash of a run is built from those of its halves
        gram = mix(gram[:-size] * _ODD + gram[size:]) if len(gram) > size else gram[:0]
        size *= 2
    step = WINDOW - 1
    return gram, mix(gram[:-step] * _ODD + gram[step:]) if len(gram) > step else gram[:0]


def _least(gram: np.ndarray) -> np.ndarray:
    """Place of the first smallest hash of each WINDOW in a row, put together from shorter windows."""
    least, at, size = gram, np.arange(len(gram)), 1
    while size < WINDOW:
        step = min(size, WINDOW - size)
        at = np.where(least[step:] < least[:-step], at[step:], at[:-step])
        least, size = np.minimum(least[step:], least[:-step]), size + step
    return at


def fingerprints(found: Words) -> Prints:
    gram, run = _runs(found)
    text = np.repeat(np.arange(len(found.bounds) - 1), np.diff(found.bounds))
    start = np.flatnonzero(text[:len(run)] == text[RUN_WORDS - 1:]) if len(run) else np.zeros(0, np.int64)
    if not len(start):
        return Prints(np.zeros(0, np.uint64), np.zeros(0, np.uint64), start, start)
    least = _least(gram)[start]
    new = np.ones(len(start), bool)
    new[1:] = (least[1:] != least[:-1]) | (np.diff(start) != 1)
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(start)) - 1
    first, windows = start[at], last - at + 1
    shape = ((least[at] - first) * WINDOW + windows).astype(np.uint64)
    kind = mix((run[first] * _ODD + run[start[last]]) * _ODD + shape)
    return Prints(gram[least[at]], kind, first, windows)


def _survey(docs: DataFrame) -> DataFrame:
    """A row for each fingerprint of every document: hash, kind, rank and key of the document, and place (first word and number of the
    windows in one number)."""
    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                found = words(batch.column("text"))
                b, prints = found.bounds, fingerprints(found)
                text = np.searchsorted(b, prints.first, "right") - 1
                place, row = (prints.first - b[text]) * 16 + prints.windows, pa.array(text)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(prints.value.view(np.int64)), pa.array(prints.kind.view(np.int64)), batch.column("rank").take(row),
                     batch.column("key").take(row), pa.array(place.astype(np.int64))], ["print", "kind", "rank", "key", "place"])

    return docs.mapInArrow(run, "print long, kind long, rank long, key long, place long")


def _windows(batches):
    """run (hash), rank, key and place (its first word) of the windows at the wanted places of the texts."""
    for whole in batches:
        for batch in slices(whole, "text"):
            found = words(batch.column("text"))
            _, run = _runs(found)
            lists = batch.column("places")
            row = np.repeat(np.arange(batch.num_rows), np.asarray(lists.value_lengths()))
            place = np.asarray(lists.flatten())
            count = place % 16
            row, place = np.repeat(row, count), np.repeat(place // 16, count)
            place = place + np.arange(len(place)) - np.repeat(np.cumsum(count) - count, count)
            value = run[found.bounds[row] + place]
            yield pa.RecordBatch.from_arrays(
                [pa.array(value.view(np.int64)), batch.column("rank").take(pa.array(row)), batch.column("key").take(pa.array(row)),
                 pa.array(place.astype(np.int64))], ["run", "rank", "key", "place"])


def _repeated(docs: DataFrame) -> DataFrame:
    """key and stretches (first word and length in one number) of the documents (key, rank, text) that hold repeated runs."""
    spark, position = docs.sparkSession, F.struct("rank", "key", "place")

    def again() -> DataFrame:
        survey = kept_table(_survey(docs), "line-survey")
        twice = survey.groupBy("print").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("print")
        return survey.join(kept_table(twice, "line-twice"), "print", "left_semi")

    seen = finished(spark, "line-seen", again)
    # rows of a kind have the same words, so the same print
    heads = kept_table(seen.groupBy("kind").agg(
        F.min("print").alias("print"), F.min(position).alias("head"), F.count(F.lit(1)).alias("n")), "line-heads")
    whole = seen.join(heads.where(F.col("n") > 1).select("kind", "head"), "kind").where(position > F.col("head")).select(
        "key", F.expr(f"place div 16 * {LENGTHS} + place % 16 + {RUN_WORDS - 1}").alias("stretch"))
    several = heads.groupBy("print").agg(F.count(F.lit(1)).alias("kinds")).where(F.col("kinds") > 1)
    wanted = heads.join(several, "print", "left_semi").groupBy(F.col("head.key").alias("key")).agg(
        F.collect_list("head.place").alias("places"))       # as many as the text has fingerprints
    runs = kept_table(docs.join(wanted, "key").select("rank", "key", "text", "places").mapInArrow(
        _windows, "run long, rank long, key long, place long"), "line-runs")
    earliest = runs.groupBy("run").agg(F.min(position).alias("head"), F.count(F.lit(1)).alias("n")).where(
        F.col("n") > 1).select("run", "head")
    parts = runs.join(earliest, "run").where(position > F.col("head")).select(
        "key", (F.col("place") * LENGTHS + RUN_WORDS).alias("stretch"))
    return whole.union(parts).groupBy("key").agg(F.collect_set("stretch").alias("stretches"))


def _cut(texts: pa.Array, stretches: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The texts without their stretches, and the number of words deleted from each."""
    found, (data, offsets) = words(texts), text_bytes(texts)
    value = np.asarray(stretches.flatten())
    row = np.repeat(np.arange(len(texts)), np.asarray(stretches.value_lengths()))
    first = found.bounds[row] + value // LENGTHS
    end = first + value % LENGTHS
    order = np.lexsort((first, row))
    row, first, reach = row[order], first[order], np.maximum.accumulate(end[order])        # no stretch leaves its text
    new = np.ones(len(row), bool)
    new[1:] = (first[1:] > reach[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    row, first, end = row[at], first[at], reach[np.append(at[1:], len(new)) - 1]
    low, base = found.starts[first], offsets[0]         # bytes go from the first word to the next one that stays, or to the text's end
    high = np.where(end < found.bounds[row + 1], found.starts[np.minimum(end, len(found.starts) - 1)], offsets[row + 1])
    change = np.zeros(offsets[-1] - base + 1, np.int8)
    change[low - base] += 1
    change[high - base] -= 1
    stay = data[base:offsets[-1]][np.cumsum(change[:-1], dtype=np.int8) == 0]
    gone = np.bincount(row, high - low, len(texts)).astype(np.int64)
    ends = offsets - base - np.concatenate([[0], np.cumsum(gone)])
    cut = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(ends), pa.py_buffer(stay))
    return cut.cast(pa.string()), np.bincount(row, end - first, len(texts)).astype(np.int64)


def dedup(docs: DataFrame, removed: str = "n_removed") -> DataFrame:
    """The documents with repeated runs cut out of their text, and the number of words deleted."""
    key, rank = free_name(docs, "key"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    narrow = keyed.select(F.col(key).alias("key"), rank.alias("rank"), "text")
    with hashed_joins(docs.sparkSession):
        by_text = finished(docs.sparkSession, "line-stretches", lambda: _repeated(narrow)).withColumnRenamed("key", key)
    name = free_name(docs, "stretches")
    joined = keyed.join(by_text.withColumnRenamed("stretches", name), key, "left").drop(key)
    columns = docs.columns
    at = columns.index("text")

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                text, lists, gone = batch.column(at), batch.column(name), np.zeros(batch.num_rows, np.int64)
                touched = np.asarray(lists.is_valid())
                if touched.any():
                    mask = pa.array(touched)
                    cut, gone[touched] = _cut(text.filter(mask), lists.filter(mask))
                    text = pc.replace_with_mask(text, mask, cut)
                out = [text if j == at else batch.column(j) for j in range(len(columns))]
                yield pa.RecordBatch.from_arrays([*out, pa.array(gone)], [*columns, removed])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return joined.select(*columns, name).mapInArrow(run, f"{fields}, `{removed}` long")


def keep_lines(docs: DataFrame, length: str | None = None) -> DataFrame:
    """The documents without repeated runs; those of which nothing is left are dropped. ``length`` names a column with the number
    of characters, which is brought up to date where a text was cut."""
    name = free_name(docs, "n_removed")
    out = dedup(docs, name)
    out = out.where((F.col(name) == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if length:
        out = out.withColumn(length, F.when(F.col(name) > 0, F.length("text")).otherwise(F.col(length)).cast(docs.schema[length].dataType))
    return out.select(*docs.columns)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(read_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "text", "n_removed")
