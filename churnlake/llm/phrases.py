"""Collocations by Toivonen mining.

A phrase is at most as frequent as any phrase that is part of it, so k words can only be frequent if their first and their last k - 1 are. A
sample of the documents, one in ``SAMPLE_OF`` at a lowered threshold, proposes phrases word by word longer. One pass over all documents then
counts the proposed phrases together with their negative border: every phrase that was not proposed although all its parts were, above
all every single word. Where a border phrase turns out frequent the sample had missed it; what contains it is not counted yet, and another
pass counts just the phrases whose parts are all proposed or missed and one of them missed, until no pass finds such a phrase.
The result is exact whatever the sample held; a bad sample costs passes.

These passes count 64-bit hashes: a task sends the hashes of its texts as sorted arrays cut by range, and ranges are added up as arrays, so a
border of mostly unique phrases costs eight bytes each and no row. Phrases with one hash would be counted together, which can only let
too much through: the last pass counts the phrases of frequent hashes once more, as texts, and these counts are the result.

Which phrases are counted is told to the tasks by bit filters of bounded size (``FILTER_BITS`` at most, 32 MB, ``PER_PHRASE`` bits a
phrase below that): a phrase that a filter takes for a proposed one in error is counted too, so the filter's size changes the work
and no result.

Everything is per language; a null language is ``und``. Null and empty texts have no words. An empty corpus, and one without frequent
phrases, gives no rows. Repeated rows count each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from churnlake.llm.tables import kept_table, read_table
from churnlake.llm.text_arrays import mix, slices, words

LONGEST = 4
LEAST = 30              # occurrences of a candidate
INSIDE_PERCENT = 80     # a longer candidate with this share of the occurrences takes a phrase's place
SCALE = 2_000_000
TOP = 2000              # phrases reported a language
SAMPLE_OF = 8
SAMPLE_LEAST = 3        # of 30 occurrences the sample holds 3.75 on average
FILTER_BITS = 1 << 28
PER_PHRASE = 16
_PROBES = 3
_SLICE = 6 << 20        # bytes of text worked on at a time
_RANGE = 16 << 20       # bytes of text for each range of hashes that one task adds up
_ROWS = 1 << 16         # phrases of an Arrow batch
_CUT = np.isin(np.arange(256), [ord(c) for c in ".,;:!?\n\x0b\x0c\r"])      # between pieces
_GAP = _CUT | np.isin(np.arange(256), [0x20, 0x09])                        # between words
_NEXT = mix(np.arange(11, 11 + LONGEST, dtype=np.uint64)) | np.uint64(1)


# -- in the tasks ----------------------------------------------------------------------------------
class Keys:
    """Hashes of all phrases of some texts: ``by_size[k][i]`` of the k words from word i on, where ``valid[k][i]``."""

    def __init__(self, texts: pa.Array, langs: pa.Array, longest: int = LONGEST):
        self.words = found = words(texts, _GAP)
        self.langs = langs.fill_null("und").dictionary_encode()
        names = words(self.langs.dictionary, np.zeros(256, bool), lower=False)
        code = np.full(len(self.langs.dictionary), 0x5F, np.uint64)         # an empty name has no word
        code[np.diff(names.bounds) > 0] = mix(names.hashes * _NEXT[0])        # a word may have the name of a language
        counts = np.diff(found.bounds)
        self.lang = np.repeat(np.asarray(self.langs.indices, np.int32), counts)
        key = mix(found.hashes ^ code[self.lang])
        begin, end = (int(found.starts[0]), int(found.starts[-1])) if len(key) else (0, 0)
        cuts = np.cumsum(_CUT[found.data[begin:end + 1]], dtype=np.int32)
        piece = cuts[found.starts - begin] + np.repeat(np.arange(len(counts), dtype=np.int32), counts)
        self.by_size, self.valid = [None, key], [None, np.ones(len(key), bool)]
        for k in range(2, longest + 1):
            longer, fits = np.zeros(len(key), np.uint64), np.zeros(len(key), bool)
            if len(key) >= k:
                longer[:1 - k] = mix(self.by_size[-1][:1 - k] * _NEXT[k - 1] + key[k - 1:])
                fits[:1 - k] = piece[:1 - k] == piece[k - 1:]
            self.by_size.append(longer)
            self.valid.append(fits)

    def texts(self, at: np.ndarray, k: int) -> pa.Array:
        """The phrases of k words from the words ``at`` on, lower case, one space between words."""
        found = self.words
        at = at[:, None] + np.arange(k)
        sizes = (found.lengths[at] + 1).ravel()
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        place = np.repeat(found.starts[at].ravel() - offsets[:-1], sizes) + np.arange(offsets[-1])
        data = found.data[np.minimum(place, max(len(found.data) - 1, 0))].copy()
        data[(data >= 0x41) & (data <= 0x5A)] += 0x20
        data[offsets[1:] - 1] = 0x20
        kept = np.ones(len(data), bool)
        kept[offsets[k::k] - 1] = False              # no space behind the last word
        bounds = offsets[::k] - np.arange(len(at) + 1)
        return pa.StringArray.from_buffers(len(at), pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data[kept]))


class Filter:
    """Bits of a set of phrase hashes. None is in the empty filter."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, np.uint64(len(bits) * 64 - 1)

    @staticmethod
    def slots(keys: np.ndarray, size: int) -> np.ndarray:
        """Bit numbers, _PROBES of a key."""
        step = mix(keys + np.uint64(0x9E3779B97F4A7C15))
        return np.concatenate([(keys + np.uint64(j) * step) & np.uint64(size - 1) for j in range(_PROBES)])

    def _set(self, slot: np.ndarray) -> np.ndarray:
        slot &= self.mask
        return (self.bits.take((slot >> np.uint64(6)).view(np.int64)) >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        """Most keys that aren't in it fail the first probe; the others are for what passes."""
        out = self._set(keys.copy())
        at = np.flatnonzero(out)
        slot = keys[at]
        step = mix(slot + np.uint64(0x9E3779B97F4A7C15))
        for _ in range(1, _PROBES):
            slot = slot + step
            found = self._set(slot.copy())
            out[at[~found]] = False
            at, slot, step = at[found], slot[found], step[found]
        return out


def _wanted(keys: Keys, sizes: list[int], old: list[Filter], new: Filter | None) -> Iterator[tuple[int, np.ndarray]]:
    """(k, words where a phrase to be counted begins). A first pass has ``old`` only; a further one counts what ``new`` makes possible."""
    for k in sizes:
        if k == 1:
            yield k, np.arange(len(keys.by_size[1]))
            continue
        at = np.flatnonzero(keys.valid[k])
        parts, fits = keys.by_size[k - 1], keys.valid[k - 1]
        known = _any(_of_size(old, k - 1), parts, fits)         # each part once, though it is the first of one phrase and the last of another
        if new is None:
            yield k, at[known[at] & known[at + 1]]
        else:
            possible = known | _any([new], parts, fits & ~known)
            yield k, at[~(known[at] & known[at + 1]) & possible[at] & possible[at + 1]]


# -- counting passes -------------------------------------------------------------------------------
def _told(spark: SparkSession, filters: list[Filter | None]):
    return spark.sparkContext.broadcast([None if x is None else x.bits for x in filters])       # FILTER_BITS each at most


def _heard(told) -> list[Filter | None]:
    return [None if bits is None else Filter(bits) for bits in told.value]


def _frequent_hashes(docs: DataFrame, sizes: list[int], least: int, ranges: int, old: list[Filter], new: Filter | None = None) -> DataFrame:
    """Rows (size, hash) of the wanted phrases whose hash occurs ``least`` times or more in all documents, kept."""
    told = _told(docs.sparkSession, [*old, new])
    shift = np.uint64(64 - max(1, (ranges - 1).bit_length()))

    def count(batches):
        *filters, extra = _heard(told)
        for whole in batches:
            for batch in slices(whole, "text", _SLICE):
                keys = Keys(batch.column("text"), batch.column("lang"), max(sizes))
                for k, at in _wanted(keys, sizes, filters, extra):
                    found, n = np.unique(keys.by_size[k][at], return_counts=True)
                    once, often, n = found[n == 1], found[n > 1], n[n > 1].astype("<u4")
                    parts = np.unique(np.concatenate([once >> shift, often >> shift]))
                    cuts = [np.searchsorted(x >> shift, [parts, parts + np.uint64(1)]).T.tolist() for x in (once, often)]
                    rows = [(once[a:b].tobytes(), often[c:d].tobytes(), n[c:d].tobytes()) for (a, b), (c, d) in zip(*cuts)]
                    if rows:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(rows), k, np.int32)), pa.array(parts.astype(np.int64)),
                             *[pa.array(x, pa.binary()) for x in zip(*rows)]], ["size", "part", "once", "often", "counts"])

    def add(table: pa.Table) -> pa.Table:
        """One range: a few bytes for each different hash in it, whatever the number of its occurrences."""
        def joined(name, kind):
            return np.concatenate([np.frombuffer(x, kind) for x in table.column(name).to_pylist()])

        once, often = joined("once", "<u8"), joined("often", "<u8")
        keys = np.concatenate([once, often])
        n = np.concatenate([np.ones(len(once), np.int64), joined("counts", "<u4").astype(np.int64)])
        order = np.argsort(keys)
        keys = keys[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        heavy = keys[first][np.add.reduceat(n[order], first) >= least]
        return pa.table({"size": pa.array(np.full(len(heavy), table.column("size")[0].as_py(), np.int32)), "hash": heavy.view(np.int64)})

    sent = docs.select("lang", "text").mapInArrow(count, "size int, part long, once binary, often binary, counts binary")
    return kept_table(sent.groupBy("size", "part").applyInArrow(add, "size int, hash long"), "phrase-hashes")


def _phrases(docs: DataFrame, filters: list[Filter], least: int) -> DataFrame:
    """Rows (lang, size, phrase, n) of the phrases the filters hold that occur ``least`` times or more, counted as texts; size 0 counts all
    words of a language."""
    told = _told(docs.sparkSession, filters)

    def run(batches):
        held = _heard(told)
        for whole in batches:
            for batch in slices(whole, "text", _SLICE):
                keys = Keys(batch.column("text"), batch.column("lang"))
                names = keys.langs.dictionary
                yield _batch(names, 0, pa.array([""] * len(names)), np.bincount(keys.lang, minlength=len(names)))
                frequent = np.ones(len(keys.by_size[1]) + 1, bool)
                for k in range(1, LONGEST + 1):
                    # only a phrase whose parts are frequent can be
                    frequent[:-1] = _any(held, keys.by_size[k], keys.valid[k] & frequent[:-1] & frequent[1:])
                    at = np.flatnonzero(frequent[:-1])
                    _, first, n = np.unique(keys.by_size[k][at], return_index=True, return_counts=True)
                    for low in range(0, len(n), _ROWS):
                        part = at[first[low:low + _ROWS]]
                        yield _batch(names.take(pa.array(keys.lang[part])), k, keys.texts(part, k), n[low:low + _ROWS])

    counted = docs.select("lang", "text").mapInArrow(run, "lang string, size int, phrase string, n long")
    summed = counted.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n"))
    return kept_table(summed.where((F.col("size") == 0) | (F.col("n") >= least)), "phrases")


def _batch(langs: pa.Array, size: int, phrases: pa.Array, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [langs.cast(pa.string()), pa.array(np.full(len(n), size, np.int32)), phrases, pa.array(n.astype(np.int64))],
        ["lang", "size", "phrase", "n"])


# -- filters ---------------------------------------------------------------------------------------
def _of_size(filters: list[Filter], size: int) -> list[Filter]:
    """Those that tell of phrases of so many words, by all passes alike: the one that ``propose`` made for the size, and the later ones, for all sizes."""
    return [filters[size - 1], *filters[LONGEST - 1:]]


def _any(filters: list[Filter], keys: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Whether a filter holds the key, for the ``asked`` ones; no for the others."""
    out, rest = np.zeros(len(keys), bool), np.flatnonzero(asked)
    for one in filters:
        found = one.holds(keys[rest])
        out[rest[found]] = True
        rest = rest[~found]
    return out


def _filter_of(hashes: DataFrame) -> Filter:
    """The filter of a table of hashes, put together from its set words."""
    size = 1 << min(FILTER_BITS.bit_length() - 1, max(10, (hashes.count() * PER_PHRASE).bit_length()))

    def run(batches):
        for batch in batches:
            slot = np.sort(Filter.slots(np.asarray(batch.column("hash")).view(np.uint64), size))
            word, first = np.unique(slot >> np.uint64(6), return_index=True)
            bits = np.bitwise_or.reduceat(np.uint64(1) << (slot & np.uint64(63)), first) if len(slot) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int32)), pa.array(bits.view(np.int64))], ["word", "bits"])

    found = hashes.select("hash").mapInArrow(run, "word int, bits long").groupBy("word").agg(
        F.bit_or("bits").alias("bits")).toArrow()           # a row for each 64 bits of the filter at most
    bits = np.zeros(size // 64, np.uint64)
    bits[np.asarray(found["word"])] = np.asarray(found["bits"]).view(np.uint64)
    return Filter(bits)


def _outside(hashes: DataFrame, filters: list[Filter]) -> DataFrame:
    """The rows whose hash no filter of their size holds, kept."""
    told = _told(hashes.sparkSession, filters)

    def run(batches):
        held = _heard(told)
        for batch in batches:
            size, known = np.asarray(batch.column("size")), np.zeros(batch.num_rows, bool)
            for k in np.unique(size).tolist():
                known |= _any(_of_size(held, k), np.asarray(batch.column("hash")).view(np.uint64), size == k)
            yield batch.filter(pa.array(~known))

    return kept_table(hashes.mapInArrow(run, hashes.schema), "phrase-hashes-missed")


# -- mining ----------------------------------------------------------------------------------------
def propose(sample: DataFrame, least: int, ranges: int) -> list[Filter]:
    """Filters of the phrases of up to LONGEST - 1 words that are frequent in a sample, found word by word longer."""
    filters: list[Filter] = []
    for k in range(1, LONGEST):
        filters.append(_filter_of(_frequent_hashes(sample, [k], least, ranges, filters)))
    return filters


def mine(docs: DataFrame, least: int = LEAST, sample_of: int = SAMPLE_OF, sample_least: int = SAMPLE_LEAST) -> DataFrame:
    """Rows (lang, size, phrase, n) of all phrases of 1 to LONGEST words with ``least`` occurrences or more, exact; size 0 has the number of
    all words of a language."""
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text", "doc_id")
    chosen = F.pmod(F.xxhash64("doc_id", "text"), F.lit(sample_of)) == 0
    sample = kept_table(docs.where(chosen).select("lang", "text"), "phrases-sample")
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // _RANGE)
    old = propose(sample, sample_least, ranges)
    fresh = _frequent_hashes(docs, list(range(1, LONGEST + 1)), least, ranges, old)
    frequent = [_filter_of(fresh)]
    while True:
        missed = _outside(fresh.where(F.col("size") < LONGEST), old)
        sizes = sorted(r["size"] + 1 for r in missed.select("size").distinct().collect())         # LONGEST - 1 at most
        if not sizes:
            return _phrases(docs, frequent, least)
        new = _filter_of(missed)
        fresh = _frequent_hashes(docs, sizes, least, ranges, old, new)
        frequent.append(_filter_of(fresh))
        old = [*old, new]


def scored(frequent: DataFrame) -> DataFrame:
    """Candidates (lang, phrase, size, a, l, r, score) that no longer candidate stands for, from the table of ``mine``."""
    terms = frequent.where("size > 0").select("lang", "phrase", "n")
    candidates = frequent.where("size > 1").select("lang", "phrase", "size", F.col("n").alias("a"))
    cuts = candidates.select("*", F.explode(F.expr("sequence(1, size - 1)")).alias("k")).withColumn(
        "first", F.expr("substring_index(phrase, ' ', k)")).withColumn("rest", F.expr("substr(phrase, length(first) + 2)"))
    cuts = cuts.join(terms.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"]).join(
        terms.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
    score = F.expr(f"(cast(a AS decimal(20,0)) * {SCALE}) div (cast(l AS decimal(20,0)) + r)")       # past 64 bits
    best = cuts.groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))

    spans = F.expr("flatten(transform(sequence(2, size - 1), m -> transform(sequence(1, size - m + 1), i -> slice(split(phrase, ' '), i, m))))")
    inner = candidates.where("size > 2").select("lang", "a", F.explode(spans).alias("inner")).select(
        "lang", F.array_join("inner", " ").alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = best.join(inner, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (100 * F.col("longer").cast("decimal(20,0)") < INSIDE_PERCENT * F.col("a").cast("decimal(20,0)")))
    return kept.select("lang", "phrase", "size", "a", "cut.l", "cut.r", "cut.score")


def best_phrases(docs: DataFrame, top: int = TOP, **limits) -> DataFrame:
    """The first ``top`` phrases of every language: lang, rank, phrase, a, l, r, n, score."""
    frequent = mine(docs, **limits)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a language's candidates are ranked in buckets first, and only the best of each bucket together
    dealt = scored(frequent).withColumn("bucket", F.pmod(F.xxhash64("phrase"), F.lit(buckets)))
    few = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "bucket").orderBy(*order))).where(F.col("rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    totals = frequent.where("size = 0").select("lang", "n")
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_toivonen_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_phrases(read_table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Every phrase of every piece counted in full.
ORACLE = rf"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS words FROM pieces),
grams AS (SELECT lang, k, unnest(list_transform(range(1, len(words) - k + 2), lambda i: array_to_string(words[i:i + k - 1], ' '))) AS phrase
    FROM w, range(1, {LONGEST + 1}) AS s(k) WHERE len(words) >= k),
f AS (SELECT lang, k, phrase, count(*) AS n FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k AS size, phrase, string_split(phrase, ' ') AS words, n AS a FROM f WHERE k > 1 AND n >= {LEAST}),
cuts AS (SELECT *, unnest(range(1, size)) AS k FROM c),
parts AS (SELECT *, array_to_string(words[1:k], ' ') AS first, array_to_string(words[k + 1:size], ' ') AS rest FROM cuts),
s AS (SELECT p.lang, p.phrase, a, k, l.n AS l, r.n AS r, (a::HUGEINT * {SCALE}) // (l.n + r.n) AS score FROM parts p
    JOIN (SELECT lang, phrase, n FROM f) l ON l.lang = p.lang AND l.phrase = p.first
    JOIN (SELECT lang, phrase, n FROM f) r ON r.lang = p.lang AND r.phrase = p.rest),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
spans AS (SELECT lang, words, a, size, unnest(range(2, size)) AS m FROM c WHERE size > 2),
inside AS (SELECT lang, a, words, m, unnest(range(1, size - m + 2)) AS i FROM spans),
longer AS (SELECT lang, array_to_string(words[i:i + m - 1], ' ') AS phrase, max(a) AS most FROM inside GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN longer o ON o.lang = b.lang AND o.phrase = b.phrase
    WHERE o.most IS NULL OR 100 * o.most < {INSIDE_PERCENT} * b.a)
SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, totals.n AS n,
    score::BIGINT AS score
FROM kept JOIN totals ON totals.lang = kept.lang
QUALIFY rank <= {TOP}
"""
