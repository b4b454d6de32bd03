"""Jaccard join of texts on word n-grams, by vertical partitioning.

A global order puts rare n-grams first: n-grams are counted over all texts in ``2 ** BUCKET_BITS`` hash buckets (a table of fixed size),
and an n-gram is ordered by its bucket's count, then by its hash. The order is cut into fragments. The first fragment of each
text is its prefix, long enough that two texts that link must share an n-gram in it; overlaps in prefixes are counted per pair, and the
count bounds the whole overlap from above, which drops nearly all pairs that don't link. For the others the overlaps of the
fragments of the rest of the order are counted separately and summed per pair; the sum decides exactly.

Texts with equal n-gram sets are one class, whatever their number. Lists of classes that share a prefix n-gram are not expanded
into all pairs: a class is first compared with the most central class of its lists, and the links found join classes to components.
Only then are pairs formed, and only between classes of different components, so a large group of near copies costs rows in
proportion to its size. Sizes and places decide inside the joins which classes meet: behind the first n-gram that two classes share both must
have as many as a link needs, so an n-gram in the back of both prefixes, where the common ones stand, pairs nothing.
The components are those of all links.

Hashes have 64 bits; a chance collision inside a pair of texts is what could change a count. Null ids and null, empty or blank texts link
with nothing. A text with fewer words than n has one n-gram, all its words. Repeated rows are one class.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlake.llm.components import components
from churnlake.llm.tables import free_name, kept_table, read_table
from churnlake.llm.text_arrays import grams, mix, slices, words

BUCKET_BITS = 20
FRAGMENTS = 8
_LOW = 64 - BUCKET_BITS
_NAMES = ["gram", "sig", "size", "place"]       # place: of the n-gram among those of its class, in the global order
_ROWS = "gram long, sig long, size long, place int"


class Order(NamedTuple):
    rank: np.ndarray        # by bucket: its place in the global order
    cuts: np.ndarray        # ranks at which fragments begin, but the first


def _sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of every text, one text after another, and the bounds by text."""
    found = words(texts)
    hashes, bounds = grams(found.hashes, found.bounds, n)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[new], owner[new]
    return hashes, np.searchsorted(owner, np.arange(len(bounds)))


def _signatures(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One number for each set, equal for equal sets."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes ^ np.uint64(0x5BD1E995)))])
    sizes = np.diff(bounds).astype(np.uint64)
    return mix(sums[bounds[1:]] - sums[bounds[:-1]] + sizes * np.uint64(0x9E3779B97F4A7C15))


def _survey(docs: DataFrame, n: int) -> DataFrame:
    """A row (id, size, sig) for each text and rows (bucket, texts) that count the n-grams of a task's texts."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches):
        counts, ids = np.zeros(1 << BUCKET_BITS, np.int64), None
        names = ["id", "size", "sig", "bucket", "texts"]
        for whole in batches:
            for batch in slices(whole, "text"):
                hashes, bounds = _sets(batch.column("text"), n)
                counts += np.bincount((hashes >> np.uint64(_LOW)).astype(np.int64), minlength=len(counts))
                sizes, sig = np.diff(bounds), _signatures(hashes, bounds).view(np.int64)
                ids, none = batch.column("id"), pa.nulls(batch.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([ids, pa.array(sizes), pa.array(sig, mask=sizes == 0), none, none], names)
        at = np.flatnonzero(counts)
        if len(at):
            none = pa.nulls(len(at), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.nulls(len(at), ids.type), none, none, pa.array(at), pa.array(counts[at])], names)

    return docs.mapInArrow(run, f"id {kind}, size long, sig long, bucket long, texts long")


def _order(survey: DataFrame) -> Order:
    sums = survey.where(F.col("bucket").isNotNull()).groupBy("bucket").agg(F.sum("texts").alias("n")).toArrow().to_pandas()
    counts = np.zeros(1 << BUCKET_BITS, np.int64)            # 2 ** BUCKET_BITS rows at most
    counts[sums["bucket"].to_numpy().astype(np.int64)] = sums["n"].to_numpy()
    order = np.argsort(counts, kind="stable")
    rank = np.empty(len(counts), np.uint32)
    rank[order] = np.arange(len(counts), dtype=np.uint32)
    mass = np.cumsum(counts[order])
    return Order(rank, np.searchsorted(mass, mass[-1] * np.arange(1, FRAGMENTS) / FRAGMENTS).astype(np.uint64))


def _ranked(hashes: np.ndarray, order: Order) -> np.ndarray:
    """The hashes as numbers in the global order: bucket's rank, then the rest of the hash."""
    rank = order.rank[(hashes >> np.uint64(_LOW)).astype(np.int64)].astype(np.uint64)
    return (rank << np.uint64(_LOW)) | (hashes & np.uint64((1 << _LOW) - 1))


def _least(size, percent: int):
    """ceil(percent / 100 * size), for numpy and for columns."""
    return (size * percent + 99) // 100 if isinstance(size, np.ndarray) else F.expr(f"({size} * {percent} + 99) div 100")


def _prefixes(docs: DataFrame, order, n: int, percent: int) -> DataFrame:
    """gram, sig, size and place for the prefix n-grams of every class a task sees."""
    def run(batches):
        seen: set[int] = set()
        for whole in batches:
            for batch in slices(whole, "text"):
                hashes, bounds = _sets(batch.column("text"), n)
                sig, sizes = _signatures(hashes, bounds), np.diff(bounds)
                usable = (sizes > 0) & np.asarray(batch.column("id").is_valid())
                fresh = np.zeros(len(sig), bool)
                for i in np.flatnonzero(usable).tolist():
                    if (s := int(sig[i])) not in seen:
                        seen.add(s)
                        fresh[i] = True
                owner = np.repeat(np.arange(len(sizes)), sizes)
                hashes, owner = _ranked(hashes[fresh[owner]], order.value), owner[fresh[owner]]
                by = np.lexsort((hashes, owner))
                hashes, owner = hashes[by], owner[by]
                first = np.searchsorted(owner, np.arange(len(sizes)))
                place = np.arange(len(owner)) - first[owner]
                take = place <= sizes[owner] - _least(sizes, percent)[owner]
                hashes, owner, place = hashes[take], owner[take], place[take]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes.view(np.int64)), pa.array(sig.view(np.int64)[owner]), pa.array(sizes[owner]),
                     pa.array(place.astype(np.int32))], _NAMES)

    return docs.mapInArrow(run, _ROWS)


def _lists(batches):
    """Of rows sorted by gram and sig: those whose gram more than one class has, each class once."""
    gram = last = waiting = None        # waiting: the first row of a list, until a second class follows
    for batch in batches:
        g, s, *rest = (np.asarray(batch.column(c)) for c in _NAMES)
        if not len(g):
            continue
        new = np.ones(len(g), bool)
        new[1:] = g[1:] != g[:-1]
        new[0] = g[0] != gram
        repeat = ~new
        repeat[1:] &= s[1:] != s[:-1]
        if not new[0]:
            repeat[0] = s[0] != last
        begin = np.maximum.accumulate(np.where(new, np.arange(len(g)), -1))     # -1: the list began in an earlier batch
        heads = begin[repeat]
        keep = repeat.copy()
        keep[heads[heads >= 0]] = True
        out = [x[keep] for x in (g, s, *rest)]
        if waiting is not None and (heads < 0).any():
            out, waiting = [np.insert(x, 0, w) for x, w in zip(out, waiting)], None
        if new.any():
            at = np.flatnonzero(new)[-1]
            waiting = None if keep[at] else [x[at] for x in (g, s, *rest)]
        gram, last = g[-1], s[-1]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], _NAMES)


def _plausible(a: str, b: str, shared: str, percent: int):
    """Whether sizes a and b and the number of n-grams shared in the prefixes allow a link."""
    least = F.expr(f"({percent} * ({a} + {b}) + {99 + percent}) div {100 + percent}")
    bound = F.col(shared) + F.greatest(_least(a, percent), _least(b, percent)) - 1
    return (100 * F.least(a, b) >= percent * F.greatest(a, b)) & (bound >= least)


def _fit(low_a, high_a, reach_a, low_b, high_b, reach_b, percent: int):
    """Whether a class with a size from low_a to high_a can link with one from low_b to high_b if the first n-gram that they share leaves
    at most reach_a and reach_b n-grams, itself included, in the global order: those must be enough for the whole overlap."""
    least = percent * (F.col(low_a) + F.col(low_b))
    return ((100 * F.col(high_a) >= percent * F.col(low_b)) & (100 * F.col(high_b) >= percent * F.col(low_a))
            & ((100 + percent) * F.col(reach_a) >= least) & ((100 + percent) * F.col(reach_b) >= least))


def _apart(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, size_a, size_b) of classes of different components that share an n-gram so early in both that they can link, from rows
    (gram, sig, size, place, root). Rows that fit none of their list go first; then components are paired, then their members."""
    spans = rows.groupBy("gram").agg(F.min("size").alias("low"), (F.min("root") != F.max("root")).alias("several"))
    reach, least = F.col("size") - F.col("place"), F.greatest("low", _least("size", percent))
    live = rows.join(spans.where("several"), "gram").where((100 + percent) * reach >= percent * (F.col("size") + least))
    live = kept_table(live.select("gram", "sig", "size", reach.alias("reach"), "root"), "ngram-live")
    groups = kept_table(live.groupBy("gram", "root").agg(
        F.min("size").alias("low"), F.max("size").alias("high"), F.max("reach").alias("reach")), "ngram-groups")
    one, two = (groups.select("gram", *(F.col(c).alias(f"{c}_{x}") for c in ("root", "low", "high", "reach"))) for x in "ab")
    meet = one.join(two, "gram").where((F.col("root_a") < F.col("root_b")) & _fit(
        "low_a", "high_a", "reach_a", "low_b", "high_b", "reach_b", percent)).select("gram", "root_a", "root_b", "low_b", "high_b", "reach_b")
    a, b = (live.select("gram", F.col("root").alias(f"root_{x}"), F.col("sig").alias(x), F.col("size").alias(f"size_{x}"),
                        F.col("reach").alias(f"left_{x}")) for x in "ab")
    half = meet.join(a, ["gram", "root_a"]).where(_fit("size_a", "size_a", "left_a", "low_b", "high_b", "reach_b", percent))
    met = half.join(b, ["gram", "root_b"]).where(_fit("size_a", "size_a", "left_a", "size_b", "size_b", "left_b", percent))
    return met.select("a", "b", "size_a", "size_b").distinct()


def _shared_prefixes(pairs: DataFrame, lists: DataFrame, percent: int) -> DataFrame:
    """The pairs whose prefixes share enough n-grams for a link."""
    ends = pairs.select(F.col("a").alias("sig")).union(pairs.select(F.col("b").alias("sig"))).distinct()
    heads = kept_table(lists.join(ends, "sig", "left_semi").groupBy("sig").agg(F.collect_list("gram").alias("grams")), "ngram-prefixes")
    side = {x: heads.select(F.col("sig").alias(x), F.col("grams").alias(f"grams_{x}")) for x in "ab"}
    met = pairs.join(side["a"], "a").join(side["b"], "b")
    counted = met.select("a", "b", "size_a", "size_b", F.size(F.array_intersect("grams_a", "grams_b")).alias("shared"))
    return counted.where(_plausible("size_a", "size_b", "shared", percent)).drop("shared")


def _fragments(docs: DataFrame, needed: DataFrame, order, n: int) -> DataFrame:
    """sig, fragment and grams (binary, sorted) of the needed classes, read from one text of each."""
    wanted = docs.join(needed, "id")

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                hashes, bounds = _sets(batch.column("text"), n)
                right = _signatures(hashes, bounds).view(np.int64) == np.asarray(batch.column("sig"))
                owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
                owner, hashes = owner[right[owner]], _ranked(hashes, order.value)[right[owner]]
                by = np.lexsort((hashes, owner))
                hashes, owner = hashes[by], owner[by]
                part = np.searchsorted(order.value.cuts, hashes >> np.uint64(_LOW), "right")
                key = owner * FRAGMENTS + part
                starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
                data, ends = hashes.tobytes(), np.append(starts[1:], len(key))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.asarray(batch.column("sig"))[owner[starts]]), pa.array(part[starts].astype(np.int32)),
                     pa.array([data[8 * a:8 * b] for a, b in zip(starts, ends)], pa.binary())], ["sig", "fragment", "grams"])

    # a repeated id can bring the text of a class more than once
    return wanted.mapInArrow(run, "sig long, fragment int, grams binary").dropDuplicates(["sig", "fragment"])


def _overlaps(batches):
    for batch in batches:
        shared = [len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
                  for x, y in zip(batch.column("grams_a").to_pylist(), batch.column("grams_b").to_pylist())]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("a", "b", "size_a", "size_b")),
                                          pa.array(shared, pa.int64())], ["a", "b", "size_a", "size_b", "shared"])


def _linked(pairs: DataFrame, docs: DataFrame, classes: DataFrame, order, n: int, percent: int) -> DataFrame:
    """The pairs (a, b, size_a, size_b) whose whole overlap is large enough."""
    pairs = kept_table(pairs, "ngram-pairs")
    ends = pairs.select(F.col("a").alias("sig")).union(pairs.select(F.col("b").alias("sig"))).distinct()
    parts = kept_table(_fragments(docs, classes.join(ends, "sig").select("id", "sig"), order, n), "ngram-fragments")
    side = {x: parts.select(F.col("sig").alias(x), "fragment", F.col("grams").alias(f"grams_{x}")) for x in "ab"}
    met = pairs.join(side["b"], "b").join(side["a"], ["a", "fragment"]).select("a", "b", "size_a", "size_b", "grams_a", "grams_b")
    counted = met.mapInArrow(_overlaps, "a long, b long, size_a long, size_b long, shared long")
    sums = counted.groupBy("a", "b", "size_a", "size_b").agg(F.sum("shared").alias("shared"))
    return sums.where(100 * F.col("shared") >= percent * (F.col("size_a") + F.col("size_b") - F.col("shared"))).select("a", "b")


def join(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """id, n_shingles and component_id (the smallest id reachable by links) for rows (id, text)."""
    context = docs.sparkSession.sparkContext
    survey = kept_table(_survey(docs, n), "ngram-survey")
    members = survey.where(F.col("bucket").isNull()).select("id", "size", "sig")
    classes = kept_table(members.where(F.col("sig").isNotNull() & F.col("id").isNotNull()).groupBy("sig").agg(
        F.min("id").alias("id")), "ngram-classes")
    if classes.isEmpty():
        return members.select("id", F.col("size").alias("n_shingles"), F.col("id").alias("component_id"))
    order = context.broadcast(_order(survey))
    entries = _prefixes(docs, order, n, percent)
    lists = kept_table(entries.repartition("gram").sortWithinPartitions("gram", "sig").mapInArrow(
        _lists, _ROWS), "ngram-lists")

    # first each class with the most central one of its lists, which shares most prefix n-grams with others
    central = lists.groupBy("sig").agg(F.count(F.lit(1)).alias("central"))
    scored = kept_table(lists.join(central, "sig"), "ngram-scored")
    heads = kept_table(scored.groupBy("gram").agg(F.max(F.struct("central", "sig", "size")).alias("m")).select(
        "gram", F.col("m.sig").alias("head"), F.col("m.size").alias("head_size")), "ngram-heads")
    shared = scored.join(heads, "gram").where(F.col("sig") != F.col("head")).groupBy("sig", "size", "head", "head_size").agg(
        F.count(F.lit(1)).alias("shared")).where(_plausible("size", "head_size", "shared", percent))
    best = shared.groupBy("sig", "size").agg(F.max(F.struct("shared", "head", "head_size")).alias("m"))
    pairs = best.select(F.col("m.head").alias("a"), F.col("sig").alias("b"), F.col("m.head_size").alias("size_a"),
                        F.col("size").alias("size_b"))
    near = kept_table(_linked(pairs, docs, classes, order, n, percent), "ngram-links")
    roots = components(near).select(F.col("node").alias("sig"), "component")

    # then the pairs of classes of different components
    rows = lists.join(roots, "sig", "left").select(*_NAMES, F.coalesce("component", "sig").alias("root"))
    rest = _shared_prefixes(kept_table(_apart(kept_table(rows, "ngram-rows"), percent), "ngram-met"), lists, percent)
    far = _linked(rest, docs, classes, order, n, percent)

    found = components(near.union(far)).select(F.col("node").alias("sig"), "component")
    named = classes.join(found, "sig", "left").select("sig", "id", F.coalesce("component", "sig").alias("root"))
    least = named.groupBy("root").agg(F.min("id").alias("component_id"))
    by_class = kept_table(named.join(least, "root").select("sig", "component_id"), "ngram-named")
    out = members.join(by_class, "sig", "left")
    own = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select("id", F.col("size").alias("n_shingles"), own.alias("component_id"))


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One row of every group of linked texts, the one with the smallest doc_id; rows without words stay."""
    row, group = free_name(docs, "row_number"), "component_id"
    numbered = kept_table(docs.withColumn(row, F.monotonically_increasing_id()), "ngram-docs")
    found = kept_table(join(numbered.select(F.col(row).alias("id"), "text"), n, percent), "ngram-found")
    ids = numbered.select(F.col(row).alias("id"), F.col("doc_id").alias("least"))
    stay = found.join(ids, "id").groupBy(group).agg(F.min(F.struct(F.col("least").isNull(), "least", "id")).alias("m"))
    return numbered.join(stay.select(F.col("m.id").alias(row)), row, "left_semi").select(*docs.columns)


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return join(docs, 4, 85).withColumnRenamed("id", "doc_id")
