"""Packing token sequences by a configuration linear program.

Documents are tokenised and closed with the end id; only longer ones than a sequence are cut, the first piece being the shorter one. What
must be packed is then a histogram of at most ``CAPACITY`` lengths, whatever the corpus, and a configuration says how many pieces of
each length fill a sequence. Multiplicative weights solve the fractional covering program: the lengths have prices, a knapsack dynamic
program finds the configuration worth most, as much of it is taken as its scarcest length allows, and the prices of the lengths it
covers fall. The amounts are scaled by the average coverage and rounded down, never beyond what is left of a length, and the
program is solved again on the histogram that remains, until rounding leaves nothing of a solution. Only those last pieces
are packed best-fit.

The plan is a table of runs (length, first rank, last rank, sequence, offset). Pieces are ranked within their length in two steps, by a
hash bucket and inside it, so that a length that a third of all pieces have is not ranked by one task.

Null and empty texts are the end id alone. Repeated rows are packed each for itself; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import math
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from churnlake.llm.byte_bpe import from_json
from churnlake.llm.tables import kept_table, read_table
from churnlake.llm.text_arrays import slices

TOKENIZER = "byte_bpe_50k.json"
CAPACITY = 1024
END = 2
ROUNDS = 0.25           # price updates per length that is left; a configuration covers several
STEP = 1.0
POWER = 1.2             # long pieces are the harder to place: first prices grow faster than lengths


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and ids (binary) of every piece."""
    def run(batches):
        codec, end = from_json(path), np.array([END], "<u4").tobytes()
        for whole in batches:
            for batch in slices(whole, "text"):
                owner, number, start, length, data = [], [], [], [], []
                for i, ids in enumerate(codec.encode(batch.column("text").to_pylist())):
                    ids += end
                    n = len(ids) // 4
                    cuts = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        owner.append(i)
                        number.append(k)
                        start.append(a)
                        length.append(b - a)
                        data.append(ids[4 * a:4 * b])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(owner, pa.int64())), pa.array(number, pa.int32()),
                     pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                     pa.array([zlib.crc32(x) for x in data], pa.int64()), pa.array(data, pa.binary())],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, ids binary")


def _dearest(price: np.ndarray, most: np.ndarray, capacity: int) -> np.ndarray:
    """Counts by length of the configuration worth most; a length is used ``most`` times at most (powers of two of it
    are the items of the knapsack)."""
    lengths = np.flatnonzero((price > 0) & (most > 0))
    best, picks = np.zeros(capacity + 1), []
    for length in lengths[::-1]:
        left, bundle = int(min(most[length], capacity // length)), 1
        while left:
            k = min(bundle, left)
            left, bundle = left - k, bundle * 2
            size = int(k * length)
            other = best[:-size] + k * price[length]
            better = np.zeros(capacity + 1, bool)
            better[size:] = other > best[size:]
            best[size:] = np.maximum(best[size:], other)
            picks.append((int(length), k, better))
    counts, room = np.zeros(len(price), np.int64), capacity
    for length, k, better in reversed(picks):
        if better[room]:
            counts[length] += k
            room -= k * length
    return counts


def _fractional(need: np.ndarray, capacity: int) -> list[tuple[float, np.ndarray]]:
    """(amount, counts by length) that cover every length about once on average, the largest amounts first."""
    live = need > 0
    worth, weight = np.arange(len(need)) ** POWER, np.where(live, 1.0, 0.0)
    used: dict[bytes, list] = {}
    for _ in range(math.ceil(ROUNDS * live.sum())):
        counts = _dearest(weight * worth, need, capacity)
        amount = (need[counts > 0] / counts[counts > 0]).min()
        used.setdefault(counts.tobytes(), [0.0, counts])[0] += amount
        weight = weight * np.exp(-STEP * amount * counts / np.maximum(need, 1))
        weight /= weight.max()
    covered = sum(amount * counts for amount, counts in used.values())
    scale = 1 / (covered[live] / need[live]).mean()
    return sorted(((amount * scale, counts) for amount, counts in used.values()), key=lambda x: -x[0])


def program(histogram: np.ndarray, capacity: int = CAPACITY) -> tuple[list[tuple[int, np.ndarray]], np.ndarray]:
    """(times, counts by length) of the rounded configuration program, and the histogram that rounding leaves."""
    left = histogram.astype(np.int64).copy()
    plan: list[tuple[int, np.ndarray]] = []
    if left[capacity]:
        full = np.zeros_like(left)
        full[capacity] = 1
        plan.append((int(left[capacity]), full))
        left[capacity] = 0
    while left.any():
        before = len(plan)
        for amount, counts in _fractional(left, capacity):
            k = int(min(amount + 1e-9, (left[counts > 0] // counts[counts > 0]).min()))
            if k:
                plan.append((k, counts))
                left = left - k * counts
        if len(plan) == before:
            break
    return plan, left


def configurations(histogram: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, np.ndarray]]:
    """(times, counts by length) that together hold exactly the histogram (index: length)."""
    plan, left = program(histogram, capacity)
    return plan + best_fit(left, capacity)


def best_fit(histogram: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, np.ndarray]]:
    """Best-fit decreasing on counts: groups of equally filled sequences take the next length together."""
    open_: dict[int, list] = {}        # room -> groups [times, counts]
    rooms: list[int] = []
    done = []

    def add(room, times, counts):
        if room == 0:
            done.append((times, counts))
            return
        if room not in open_:
            open_[room] = []
            bisect.insort(rooms, room)
        open_[room].append((times, counts))

    for length in range(len(histogram) - 1, 0, -1):
        left = int(histogram[length])
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                times, counts = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(at)
                k = min(times, left)
                if times > k:
                    add(room, times - k, counts)
                each = 1
            else:
                room, counts = capacity, np.zeros_like(histogram)
                each = capacity // length
                k = left // each
                if not k:
                    each, k = left, 1
            counts = counts.copy()
            counts[length] += each
            left -= k * each
            add(room - each * length, k, counts)
    return done + [group for groups in open_.values() for group in groups]


def _runs(plan: list[tuple[int, np.ndarray]]) -> dict[int, list[np.ndarray]]:
    """By length: first ranks, pieces per sequence, first sequence, offset of the first piece."""
    rank: dict[int, int] = {}
    runs: dict[int, list] = {}
    sequence = 0
    for times, counts in plan:
        offset = 0
        for length in np.flatnonzero(counts).tolist():
            each = int(counts[length])
            runs.setdefault(length, []).append((rank.get(length, 0), each, sequence, offset))
            rank[length] = rank.get(length, 0) + times * each
            offset += each * length
        sequence += times
    return {length: [np.array(x, np.int64) for x in zip(*rows)] for length, rows in runs.items()}


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces (a kept table with doc_id, piece and length) with sequence_id and offset."""
    spark = cut.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = cut.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    sizes = cut.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("n"))
    # capacity * buckets rows at most; the running sums of a length are over its buckets only
    first = sizes.withColumn("_first", F.sum("n").over(
        Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)))
    totals = sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()         # capacity rows at most
    histogram = np.zeros(capacity + 1, np.int64)
    for row in totals:
        histogram[row["length"]] = row["n"]
    runs = spark.sparkContext.broadcast(_runs(configurations(histogram, capacity)) if totals else {})
    inside = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = cut.withColumn("_inside", inside).join(first.drop("n"), ["length", "_bucket"]).withColumn(
        "_rank", F.col("_inside") + F.coalesce("_first", F.lit(0))).drop("_bucket", "_inside", "_first")
    columns = [c for c in ranked.columns if c != "_rank"]

    def run(batches):
        table = runs.value
        for batch in batches:
            length, rank = np.asarray(batch.column("length")), np.asarray(batch.column("_rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for value in np.unique(length).tolist():
                rows = np.flatnonzero(length == value)
                begin, each, first_sequence, start = table[value]
                at = np.searchsorted(begin, rank[rows], "right") - 1
                place = rank[rows] - begin[at]
                sequence[rows] = first_sequence[at] + place // each[at]
                offset[rows] = start[at] + value * (place % each[at])
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in columns], pa.array(sequence), pa.array(offset)], [*columns, "sequence_id", "offset"])

    fields = ", ".join(f"`{c}` {ranked.schema[c].dataType.simpleString()}" for c in columns)
    return ranked.mapInArrow(run, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, keep_ids: bool = False) -> DataFrame:
    """One row for each piece of every document; with ``keep_ids`` also its ids (little-endian unsigned 32-bit)."""
    cut = pieces(docs.select("doc_id", "text"), public_tokenizers.path(TOKENIZER))
    return pack(kept_table(cut if keep_ids else cut.drop("ids"), "pack-pieces"))


def op2_config_lp_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
