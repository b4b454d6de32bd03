"""Scoring texts by a hidden Markov language model.

Symbols are the ``HEAD`` most frequent training words (seen twice or more), the end of a text, and one symbol for all rarer words, which are then drawn
by their own smoothed frequency (with one place for unseen words), so the model is a proper distribution over word sequences.
Baum-Welch trains the latent states: every task runs the forward and backward recursions over its sequences and emits
expected counts, which are summed across partitions; all training texts count whole in every pass. The first pass starts
from noise over the counts of all training texts. Sequences lie packed step by step, without padding, and their messages are kept, in groups of
``TOKENS`` tokens. A longer text is trained on block by block, and the forward and backward messages are handed from block to block, so the
counts are those of the whole sequence. Within a block, texts of more than ``SEGMENT`` tokens go as segments side by side: the product of a segment's
steps, a matrix of states by states, says beforehand which messages enter it from both sides, so few long texts cost no steps of their own.
The score is the exact sequence likelihood by the scaled forward recursion, handed on likewise.

Texts are tokenised once, into a table of symbol ids in the shared folder; counts of rare words reach their texts by a join, since
their number grows with the corpus. Null texts are empty, and an empty text is the end symbol alone. Repeated rows are scored
each for itself. Without training text every word is unseen.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlake.llm.tables import fold_of, kept_table, read_table
from churnlake.llm.text_arrays import slices, words

FOLDS, HELD_OUT = 5, 1
HEAD = 32_768           # words with a symbol of their own
STATES = 8
PASSES = 14
BEGIN_BITS = 18         # leading bits by which a word's place in the head is looked up
SCALED = 8              # steps of the recursions from one scaling to the next
SEGMENT = 1 << 11       # tokens of a text gone through one after another; the segments of a longer text go side by side
TOKENS = 1 << 19        # tokens worked on at a time
CHUNK = 1024            # rows of the table of expected counts that are shuffled as one value
LEAST_COUNT = 2         # rarer words share the rare symbol
DISCOUNT = 0.5          # taken from every expected count and given to the unigram distribution


class Vocabulary(NamedTuple):
    words: np.ndarray       # sorted hashes of the head
    symbols: np.ndarray     # their symbols, 0 for the most frequent
    counts: np.ndarray      # training count by symbol: head, end, rare
    total: int              # N, training tokens with ends
    types: int              # V, distinct training tokens

    @property
    def end(self) -> int:
        return len(self.words)

    @property
    def rare(self) -> int:
        return len(self.words) + 1

    def base(self, count) -> np.ndarray:
        """log10 probability of the smoothed unigram model."""
        return np.log10((np.asarray(count) + 0.5) / (self.total + 0.5 * (self.types + 1)))


class Parameters(NamedTuple):
    start: np.ndarray       # K
    move: np.ndarray        # K x K
    emit: np.ndarray        # symbols x K


def _word_counts(docs: DataFrame) -> DataFrame:
    """word (hash) and n over the given texts."""
    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text", 8 << 20):
                key, n = np.unique(words(batch.column("text")).hashes, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["word", "n"])

    return docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame, texts: int) -> Vocabulary:
    top = counts.where(F.col("n") >= LEAST_COUNT).orderBy(F.desc("n"), "word").limit(HEAD).toArrow().to_pandas()          # HEAD rows
    sums = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    hashes = top["word"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    tokens, head = int(sums["n"] or 0), int(top["n"].sum())
    by_symbol = np.concatenate([top["n"].to_numpy(), [texts, tokens - head]]).astype(float)
    return Vocabulary(hashes[order], order.astype(np.int64), by_symbol, tokens + texts, int(sums["v"]) + bool(texts))


def _places(sorted_words: np.ndarray, begins: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The place of each hash among the words if it is one of them, else any place; ``begins`` has the first place by leading bits."""
    last = len(sorted_words) - 1
    at = np.minimum(begins.take((hashes >> np.uint64(64 - BEGIN_BITS)).astype(np.intp)), last)
    late = np.flatnonzero(sorted_words[at] < hashes)
    while len(late):            # a step for each word with the same leading bits
        late = late[at[late] < last]
        at[late] += 1
        late = late[sorted_words[at[late]] < hashes[late]]
    return at


def _encode(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """doc_id, held_out, n_words, ids (little-endian int32 symbols with the end) and rare (hashes of the rare words)."""
    shipped = docs.sparkSession.sparkContext.broadcast(vocab)

    def run(batches):
        v = shipped.value
        begins = np.searchsorted(v.words, np.arange(1 << BEGIN_BITS, dtype=np.uint64) << np.uint64(64 - BEGIN_BITS))
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                found = words(batch.column("text"))
                ids = np.full(len(found.hashes), v.rare, np.int32)
                if len(v.words):
                    at = _places(v.words, begins, found.hashes)
                    ids = np.where(v.words[at] == found.hashes, v.symbols[at], v.rare).astype("<i4")
                ends = found.bounds[1:]
                is_rare = np.flatnonzero(ids == v.rare)
                rare = found.hashes[is_rare].tobytes()
                is_rare = np.searchsorted(is_rare, found.bounds)
                text = np.insert(ids, ends, v.end).tobytes()
                bounds = found.bounds + np.arange(len(found.bounds))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("held_out"), pa.array(np.diff(found.bounds)),
                     pa.array([text[4 * a:4 * b] for a, b in zip(bounds, bounds[1:])], pa.binary()),
                     pa.array([rare[8 * a:8 * b] for a, b in zip(is_rare, is_rare[1:])], pa.binary())],
                    ["doc_id", "held_out", "n_words", "ids", "rare"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_words long, "
                                "ids binary, rare binary")


def _groups(ids: list[np.ndarray]) -> Iterator[list[int]]:
    """Numbers of the sequences that aren't empty, longest first, in groups of at most TOKENS tokens; a longer one alone."""
    size = np.array([len(x) for x in ids], np.int64)
    group, total = [], 0
    for i in np.argsort(-size, kind="stable")[:np.count_nonzero(size)].tolist():
        if group and total + size[i] > TOKENS:
            yield group
            group, total = [], 0
        group.append(i)
        total += size[i]
    if group:
        yield group


def _packed(texts: list[np.ndarray]) -> tuple[np.ndarray, list[int], np.ndarray]:
    """Ids of the texts (longest first) step by step, where each step begins, and the place of each text's last id."""
    size, n = np.array([len(x) for x in texts]), np.arange(len(texts))
    at = np.concatenate([[0], np.cumsum(np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right"))])
    place = np.concatenate([at[:length] for length in size])
    place += np.repeat(n, size)
    packed = np.empty(at[-1], np.intp)
    packed[place] = np.concatenate(texts)
    return packed, at.tolist(), at[size - 1] + n


def _forward(p: Parameters, ids: np.ndarray, at: list[int], first: np.ndarray, room: list[np.ndarray]):
    """Forward messages and emissions (K x tokens), and the scales by step: every SCALED-th message is brought to a sum of one. ``first`` (K x
    sequences) are the probabilities of their first states."""
    k = len(p.start)
    if not room or len(room[0]) < k * len(ids):         # kept from group to group
        room[:] = [np.empty(k * len(ids)) for _ in range(2)]
    emit, forward = (x[:k * len(ids)].reshape(k, -1) for x in room)
    for state in range(k):
        p.emit[:, state].take(ids, out=emit[state], mode="clip")
    scales, move = {}, p.move.T.copy()
    for t in range(len(at) - 1):
        low, high = at[t], at[t + 1]
        a = forward[:, low:high]
        if t:
            np.matmul(move, forward[:, at[t - 1]:at[t - 1] + high - low], out=a)
            a *= emit[:, low:high]
        else:
            np.multiply(first, emit[:, :high], out=a)
        if t % SCALED == SCALED - 1:
            scales[t] = a.sum(axis=0)
            a /= scales[t]
    return forward, emit, scales


def _blocks(texts: list[np.ndarray]) -> list[list[np.ndarray]]:
    """A group as one block, a text of more than TOKENS tokens as several."""
    return [[texts[0][low:low + TOKENS]] for low in range(0, len(texts[0]), TOKENS)] if len(texts[0]) > TOKENS else [texts]


class Segments(NamedTuple):
    ids: list[np.ndarray]       # longest first
    text: np.ndarray            # number of the text
    before: np.ndarray          # number of the segment before it in the text, -1 for the first


def _segments(texts: list[np.ndarray]) -> Segments:
    """The texts (longest first) in segments of at most SEGMENT tokens."""
    cuts = [(i, low) for i, x in enumerate(texts) for low in range(0, len(x), SEGMENT)]
    ids = [texts[i][low:low + SEGMENT] for i, low in cuts]
    order = np.argsort([-len(x) for x in ids], kind="stable")
    place = np.empty(len(ids) + 1, np.int64)
    place[order], place[-1] = np.arange(len(ids)), -1
    before = place[[k - 1 if low else -1 for k, (_, low) in enumerate(cuts)]]
    return Segments([ids[k] for k in order.tolist()], np.array([i for i, _ in cuts])[order], before[order])


def _through(p: Parameters, ids: list[np.ndarray]) -> np.ndarray:
    """Of each segment (longest first) the matrix from its first state to its last one, all emissions included, but for a factor."""
    k, size = len(p.start), np.array([len(x) for x in ids])
    table = np.zeros((len(ids), size[0]), np.intp)
    for row, x in zip(table, ids):
        row[:len(x)] = x
    live = np.searchsorted(-size, -np.arange(size[0])).tolist()        # longer ones than so many steps
    out, log = p.emit[table[:, 0]][:, None, :] * np.eye(k), np.zeros((len(ids), k))
    for t in range(1, size[0]):
        now = out[:live[t]]
        now[:] = (now.reshape(-1, k) @ p.move).reshape(now.shape)
        now *= p.emit[table[:live[t], t]][:, None, :]
        if t % SCALED == SCALED - 1:
            scale = now.sum(axis=2)
            now /= scale[:, :, None]
            log[:live[t]] += np.log(scale)
    return out * np.exp(log - log.max(axis=1, keepdims=True))[:, :, None]


def _handed(p: Parameters, cut: Segments, first: np.ndarray, message: np.ndarray | None = None):
    """Three tables (K x segments): probabilities of the segments' first states, the forward messages that enter them (sum one) where
    there is a segment before, and the backward messages at their ends, but for a factor. ``message`` is that at the end of a single text."""
    n = len(cut.ids)
    firsts, entering, back = np.repeat(first[:, None], n, axis=1), np.zeros((len(first), n)), np.ones((len(first), n))
    if message is not None:
        back[:, np.setdiff1d(np.arange(n), cut.before)] = message[:, None]
    later = np.flatnonzero(cut.before >= 0)
    if len(later):
        among = np.union1d(later, cut.before[later])
        through = dict(zip(among.tolist(), _through(p, [cut.ids[i] for i in among.tolist()])))
        links = [(int(cut.before[i]), i) for i in later[np.argsort(cut.text[later], kind="stable")].tolist()]     # in order of a text
        for a, b in links:
            end = firsts[:, a] @ through[a]
            entering[:, b] = end / end.sum()
            firsts[:, b] = entering[:, b] @ p.move
        for a, b in reversed(links):
            start = p.move @ (through[b] @ back[:, b])
            back[:, a] = start / start.sum()
    return firsts, entering, back


def _leaving(p: Parameters, text: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The forward message at the end of a text, brought to a sum of one."""
    for through in _through(p, [text[low:low + SEGMENT] for low in range(0, len(text), SEGMENT)]):
        end = first @ through
        end /= end.sum()
        first = end @ p.move
    return end


def expected_counts(ids: list[np.ndarray], p: Parameters) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected starts, moves and emissions of the whole sequences (Baum-Welch)."""
    k = len(p.start)
    start, move, emit = np.zeros(k), np.zeros((k, k)), np.zeros_like(p.emit)
    room: list[np.ndarray] = []
    for group in _groups(ids):
        blocks = _blocks([ids[i] for i in group])
        leaving = []                # forward messages at the ends of the blocks that have a next one
        for block in blocks[:-1]:
            leaving.append(_leaving(p, block[0], leaving[-1] @ p.move if leaving else p.start))
        message = None              # from the next block
        for number in range(len(blocks) - 1, -1, -1):
            cut = _segments(blocks[number])
            first, entering, back = _handed(p, cut, leaving[number - 1] @ p.move if number else p.start, message)
            handed = cut.before >= 0
            if number:
                entering[:, ~handed] = leaving[number - 1][:, None]
            packed, at, last = _packed(cut.ids)
            forward, weighted, scales = _forward(p, packed, at, first, room)
            back /= (forward[:, last] * back).sum(axis=0)
            for t in range(len(at) - 2, -1, -1):
                low, high = at[t], at[t + 1]
                b, w = back[:, :high - low], weighted[:, low:high]
                w *= b
                if t in scales:
                    w /= scales[t]
                forward[:, low:high] *= b
                if t:
                    move += forward[:, at[t - 1]:at[t - 1] + high - low] @ w.T
                    np.matmul(p.move, w, out=b)
            move += entering @ weighted[:, :at[1]].T
            if number:
                message = p.move @ weighted[:, np.flatnonzero(~handed)[0]]
            else:
                start += forward[:, :at[1]][:, ~handed].sum(axis=1)
            for state in range(k):
                emit[:, state] += np.bincount(packed, forward[state], len(emit))
    return start, move * p.move, emit


def _normalised(start, move, emit, vocab: Vocabulary) -> Parameters:
    prior = (vocab.counts + 0.5) / (vocab.counts + 0.5).sum()
    cut = np.minimum(emit, DISCOUNT)
    emit = emit - cut + (cut.sum(axis=0) + 1.0) * prior[:, None]
    return Parameters((start + 0.5) / (start + 0.5).sum(), (move + 0.5) / (move + 0.5).sum(axis=1, keepdims=True),
                      emit / emit.sum(axis=0))


def _added(batches):
    """The sums of the tasks' counts by chunk; all rows of a chunk are in one partition."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, x in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist()):
            sums[i] = sums[i] + np.frombuffer(x) if i in sums else np.frombuffer(x)
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([x.tobytes() for x in sums.values()], pa.binary())],
                                     ["chunk", "counts"])


def train(sequences: DataFrame, vocab: Vocabulary) -> Parameters:
    """Baum-Welch over the ids of the given sequences."""
    context = sequences.sparkSession.sparkContext
    rng = np.random.default_rng(7)
    noise = rng.gamma(1.0, 1.0, (len(vocab.counts), STATES))
    p = _normalised(np.ones(STATES), np.ones((STATES, STATES)) + 4 * np.eye(STATES),
                    vocab.counts[:, None] * noise, vocab)
    for _ in range(PASSES):
        shipped = context.broadcast(p)

        def run(batches):
            total = None
            for batch in batches:
                ids = [np.frombuffer(x, "<i4") for x in batch.column("ids").to_pylist()]
                got = expected_counts(ids, shipped.value)
                total = got if total is None else [x + y for x, y in zip(total, got)]
            if total is None:
                return
            start, move, emit = total
            table = np.concatenate([start[None], move, emit])
            chunks = [(i, table[low:low + CHUNK]) for i, low in enumerate(range(0, len(table), CHUNK))]
            chunks = [(i, x.tobytes()) for i, x in chunks if x.any()]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in chunks]), pa.array([x for _, x in chunks], pa.binary())],
                                             ["chunk", "counts"])

        counted = sequences.select("ids").mapInArrow(run, "chunk long, counts binary")
        sums = counted.repartition("chunk").mapInArrow(_added, "chunk long, counts binary").toArrow()
        table = np.zeros((1 + STATES + len(vocab.counts), STATES))      # bounded by HEAD
        for i, x in zip(sums.column("chunk").to_pylist(), sums.column("counts").to_pylist()):
            table[i * CHUNK:(i + 1) * CHUNK] = np.frombuffer(x).reshape(-1, STATES)
        p = _normalised(table[0], table[1:1 + STATES], table[1 + STATES:], vocab)
    return p


def log10_likelihood(ids: list[np.ndarray], p: Parameters) -> np.ndarray:
    """log10 probability of every sequence."""
    out, room = np.zeros(len(ids)), []
    for group in _groups(ids):
        first, log = p.start, np.zeros(len(group))
        for block in _blocks([ids[i] for i in group]):
            cut = _segments(block)
            packed, at, last = _packed(cut.ids)
            forward, _, scales = _forward(p, packed, at, _handed(p, cut, first)[0], room)
            ends = forward[:, last]
            parts = np.log10(ends.sum(axis=0))
            for scale in scales.values():
                parts[:len(scale)] += np.log10(scale)
            log += np.bincount(cut.text, parts, len(log))
            end = ends[:, np.setdiff1d(np.arange(len(cut.ids)), cut.before)[0]]
            first = end / end.sum() @ p.move        # of the block's only text, if it has a next block
        out[group] = log
    return out


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score, by row."""
    spark = docs.sparkSession
    held = F.coalesce(fold_of(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out")
    docs = docs.select("doc_id", held, "text")
    train_docs = docs.where(~F.col("held_out"))
    counts = kept_table(_word_counts(train_docs), "hmm-counts")
    vocab = vocabulary(counts, train_docs.select("held_out").count())
    encoded = _encode(docs, vocab).withColumn("row", F.monotonically_increasing_id())
    sequences = kept_table(encoded, "hmm-sequences")        # from here on row ids are fixed
    p = train(sequences.where(~F.col("held_out")), vocab)

    def rare(batches):
        for batch in batches:
            row = np.asarray(batch.column("row"))
            found = [np.frombuffer(x, np.int64) for x in batch.column("rare").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(row, [len(x) for x in found])), pa.array(np.concatenate([*found, np.zeros(0, np.int64)]))],
                ["row", "word"])

    tail_total, tail_types = vocab.counts[vocab.rare], max(0, vocab.types - 1 - len(vocab.words))
    base_floor, rare_floor = vocab.total + 0.5 * (vocab.types + 1), tail_total + 0.5 * (tail_types + 1)
    n = F.coalesce(F.col("n"), F.lit(0))
    tail = sequences.select("row", "rare").mapInArrow(rare, "row long, word long").join(counts, "word", "left")
    tail = tail.groupBy("row").agg(
        F.sum(F.log10((n + 0.5) / base_floor)).alias("rare_base"), F.sum(F.log10((n + 0.5) / rare_floor)).alias("rare_score"),
        F.sum((n > 0).cast("long")).alias("rare_known"))
    shipped = spark.sparkContext.broadcast((vocab, p))

    def score(batches):
        v, q = shipped.value
        by_symbol = np.append(v.base(v.counts[:-1]), 0.0)
        known = np.append(v.counts[:-1] > 0, False)
        for batch in batches:
            ids = [np.frombuffer(x, "<i4") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), batch.column("held_out"), pa.array([len(x) for x in ids], pa.int64()),
                 pa.array([int(known[x].sum()) for x in ids], pa.int64()), pa.array([float(by_symbol[x].sum()) for x in ids], pa.float64()),
                 pa.array(log10_likelihood(ids, q))],
                ["row", "doc_id", "held_out", "n_tokens", "head_known", "head_base", "head_score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    head = sequences.select("row", "doc_id", "held_out", "ids").mapInArrow(
        score, f"row long, doc_id {kind}, held_out boolean, n_tokens long, head_known long, head_base double, head_score double")

    def plus(a, b, zero):
        return F.col(a) + F.coalesce(F.col(b), F.lit(zero))

    return head.join(tail, "row", "left").select(
        "doc_id", "held_out", "n_tokens", plus("head_known", "rare_known", 0).alias("n_known"),
        F.lit(vocab.total).cast("long").alias("train_tokens"),
        plus("head_base", "rare_base", 0.0).alias("base_score"), plus("head_score", "rare_score", 0.0).alias("score"))


def op5_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
