"""Histogram training of tree ensembles over packed blocks of rows.

A partition of the training rows is one block: the bin of every feature of every row, a byte each, column after column, and the labels. A pass
reads the blocks with numpy and adds up, for every open node, what each bin of each feature holds; the best cut of a node follows from these
sums. Thresholds, gains, stopping, pruning and importances are those of Spark ML (32 bins), and the result is a Spark ML model.

Boosting draws the rows of a round as Spark does and sums in row order, so that a table of one partition gives Spark's trees. A round is a pass
a level; a task sends its sums of the open nodes (at most 2^(depth - 1)) to the driver, which chooses. The forest grows all trees a level a pass;
sums meet by tree in a shuffle, and only chosen cuts reach the driver. Its bootstrap counts are drawn anew in each pass from (seed, tree, partition)
and never stored; they are other draws than those of Spark's forest.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.classification import (
    GBTClassificationModel, GBTClassifier, RandomForestClassificationModel, RandomForestClassifier,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from churnlake.session import remove_path, shared_folder, work_path

SAMPLED_ROWS = 10_000           # that thresholds are taken from, as in Spark ML
CHECKPOINT_ROUNDS = 25          # after so many rounds the rows' predictions are written, so that lineage stays short
_INVALID = -np.finfo(float).max
_EPSILON = 2.220446049250313e-16
_MASK = (1 << 64) - 1


# -- Spark's random numbers ------------------------------------------------------------------------
def _murmur3(data: bytes, seed: int) -> int:
    """32-bit MurmurHash3 of eight bytes, as scala.util.hashing computes it."""
    h = seed
    for k in np.frombuffer(data, "<u4").tolist():
        k = k * 0xCC9E2D51 & 0xFFFFFFFF
        k = (k << 15 | k >> 17) & 0xFFFFFFFF
        h ^= k * 0x1B873593 & 0xFFFFFFFF
        h = (h << 13 | h >> 19) & 0xFFFFFFFF
        h = (h * 5 + 0xE6546B64) & 0xFFFFFFFF
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & 0xFFFFFFFF
    h = (h ^ h >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
    return h ^ h >> 16


def _hashed_seed(seed: int) -> int:
    data = (seed & _MASK).to_bytes(8, "big")
    low = _murmur3(data, 0x3C074A61)        # arraySeed of scala.util.hashing.MurmurHash3
    return _murmur3(data, low) << 32 | low


def _stepped(x: np.ndarray) -> np.ndarray:
    x = x ^ x << np.uint64(21)
    x = x ^ x >> np.uint64(35)
    return x ^ x << np.uint64(4)


def _jumped(x: np.ndarray, tables: np.ndarray) -> np.ndarray:
    out = tables[0][x & np.uint64(255)]
    for j in range(1, 8):
        out ^= tables[j][x >> np.uint64(8 * j) & np.uint64(255)]
    return out


@lru_cache(maxsize=64)
def _jump(power: int) -> np.ndarray:
    """Tables by byte of the linear map of 2^power steps."""
    bits = np.uint64(1) << np.arange(64, dtype=np.uint64)
    images = _stepped(bits) if power == 0 else _jumped(_jumped(bits, _jump(power - 1)), _jump(power - 1))
    tables = np.zeros((8, 256), np.uint64)
    for j in range(8):
        part = np.zeros(1, np.uint64)
        for image in images[8 * j:8 * j + 8]:
            part = np.concatenate([part, part ^ image])
        tables[j] = part
    return tables


def _states(seed: int, n: int) -> np.ndarray:
    """The first ``n`` states after the seed of Spark's XORShiftRandom: each step doubles what there is."""
    states, power = _stepped(np.array([_hashed_seed(seed)], np.uint64)), 0
    while len(states) < n:
        states = np.concatenate([states, _jumped(states[:n - len(states)], _jump(power))])
        power += 1
    return states[:n]


def uniform(seed: int, n: int) -> np.ndarray:
    """``n`` values of XORShiftRandom(seed).nextDouble()."""
    states = _states(seed, 2 * n)
    high, low = states[::2] & np.uint64((1 << 26) - 1), states[1::2] & np.uint64((1 << 27) - 1)
    return ((high << np.uint64(27)) + low).astype(float) * 2.0 ** -53


# -- bins ------------------------------------------------------------------------------------------
def _cuts(weights: dict[float, float], count: int, expected: float, most: int) -> np.ndarray:
    """Thresholds of a feature from the weights of its values other than 0, whose weight is what is missing to ``expected``."""
    if not weights:
        return np.zeros(0)
    known = sum(weights.values())
    if expected - known > _EPSILON * count * 100:
        weights = weights | {0.0: expected - known}
    values = sorted(weights)
    if len(values) - 1 <= most:
        return np.array([(a + b) / 2.0 for a, b in zip(values, values[1:])])
    stride = expected / (most + 1)
    cuts, current, target = [], weights[values[0]], stride
    for before, value in zip(values, values[1:]):
        previous = current
        current += weights[value]
        if abs(previous - target) < abs(current - target):
            cuts.append((before + value) / 2.0)
            target += stride
    return np.array(cuts)


def thresholds(rows: DataFrame, n: int, width: int, bins: int, seed: int, weights: tuple[float, float], weight_sum: float) -> list[np.ndarray]:
    """Quantiles of each feature, from at least 10,000 rows or all there are, weighted by class."""
    share = min(1.0, max(bins * bins, SAMPLED_ROWS) / n)
    if share < 1:
        draw = int(_states(seed, 1)[0] & np.uint64(0xFFFFFFFF))
        spark = rows.sparkSession
        sampled = rows._jdf.toJavaRDD().sample(False, share, draw - (1 << 32) if draw >> 31 else draw)
        rows = DataFrame(spark._jsparkSession.createDataFrame(sampled, rows._jdf.schema()), spark)
    weight = F.when(F.col("label") == 1, weights[1]).otherwise(weights[0])
    cells = rows.select(weight.alias("w"), F.posexplode(vector_to_array("features")).alias("i", "x")).where("x != 0")
    found: list[dict] = [{} for _ in range(width)]
    counts = [0] * width
    for r in cells.groupBy("i", "x").agg(F.sum("w").alias("w"), F.count("*").alias("n")).collect():     # of the sampled rows
        found[r["i"]][r["x"]] = r["w"]
        counts[r["i"]] += r["n"]
    most = min(bins, n) - 1
    return [_cuts(x, count, share * weight_sum, most) for x, count in zip(found, counts)]


def packed(rows: DataFrame, cuts: list[np.ndarray]) -> RDD:
    """A block (bins, labels) for each partition that has rows, kept for the passes."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, labels = [], []
        for batch in batches:
            values = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            parts.append(np.stack([np.searchsorted(x, values[:, i]).astype(np.uint8) for i, x in enumerate(cuts)]))
            labels.append(batch.column(1).to_numpy(zero_copy_only=False))
        if sum(map(len, labels)):
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(parts, axis=1).tobytes()], pa.large_binary()),
                                              pa.array([np.concatenate(labels).tobytes()], pa.large_binary())], ["bins", "labels"])

    arrays = rows.select(vector_to_array("features").alias("x"), F.col("label").cast("double"))
    blocks = arrays.mapInArrow(pack, "bins binary, labels binary").rdd
    return blocks.map(lambda r: (bytes(r[0]), bytes(r[1]))).persist(StorageLevel.MEMORY_AND_DISK)


def _columns(bins: bytes, labels: bytes) -> tuple[np.ndarray, np.ndarray]:
    y = np.frombuffer(labels)
    return np.frombuffer(bins, np.uint8).reshape(-1, len(y)), y


def _walked(bins: np.ndarray, rows: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
    """Place of each row in the heap of a tree after ``levels`` cuts; rows of closed nodes go on to the left."""
    n, flat, at = bins.shape[1], bins.reshape(-1), np.zeros(len(rows), np.int64)
    for _ in range(levels):
        more = flat[feature[at] * n + rows] > cut[at]
        at *= 2
        at += 1
        at += more
    return at


# -- trees -----------------------------------------------------------------------------------------
@dataclass
class Tree:
    """A heap of nodes: the children of i are 2i + 1 and 2i + 2. ``stats`` are the impurity's numbers and then the rows."""

    feature: np.ndarray
    cut: np.ndarray
    split: np.ndarray
    gain: np.ndarray
    impurity: np.ndarray
    stats: np.ndarray

    @classmethod
    def empty(cls, depth: int, width: int) -> "Tree":
        n = (1 << depth + 1) - 1
        return cls(np.zeros(n, np.int64), np.full(n, 255, np.uint8), np.zeros(n, bool), np.zeros(n), np.zeros(n), np.zeros((n, width)))

    def closed_at(self, predictions: np.ndarray, levels: int) -> np.ndarray:
        """The prediction of the leaf at or above each place of the last level."""
        value = predictions.copy()
        for i in range((1 << levels) - 1):
            if not self.split[i]:
                value[2 * i + 1] = value[2 * i + 2] = value[i]
        return value


def _variance(s: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(s[..., 0] == 0, 0.0, (s[..., 2] - s[..., 1] * s[..., 1] / s[..., 0]) / s[..., 0])


def _mean(s: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(s[..., 0] == 0, 0.0, s[..., 1] / s[..., 0])


def _exp(x: np.ndarray) -> np.ndarray:
    """e^x as the JVM's StrictMath (fdlibm) computes it, to the last bit; numpy's differs there for one value in ten, and equal gains are told apart by such bits."""
    x = np.clip(x, -746.0, 710.0)
    word = np.abs(x).view(np.int64) >> 32
    half = np.where(x < 0, -0.5, 0.5)
    k = np.where(word < 0x3FF0A2B2, 2 * half, np.trunc(1.44269504088896338700 * x + half)) * (word > 0x3FD62E42)
    high, low = x - k * 6.93147180369123816490e-01, k * 1.90821492927058770002e-10
    r = high - low
    t = r * r
    c = r - t * (1.66666666666666019037e-01 + t * (-2.77777777770155933842e-03 + t * (
        6.61375632143793436117e-05 + t * (-1.65339022054652515390e-06 + t * 4.13813679705723846039e-08))))
    with np.errstate(over="ignore", under="ignore"):
        return np.where(word < 0x3E300000, 1.0 + x, np.ldexp(1.0 - ((low - r * c / (2.0 - c)) - high), k.astype(np.int32)))


def _drawn(block: tuple, seed: int, share: float, tree: Tree | None, weight: float, levels: int, part: int) -> tuple:
    """The block of the next round: predictions moved on by the last tree, residuals, and which rows take part."""
    bins, y = _columns(*block[:2])
    n, sign = len(y), 2 * y - 1
    before = np.frombuffer(block[2]) if len(block) > 2 else np.zeros(n)
    if tree is None:
        moved, residual = before, sign
    else:
        value = tree.closed_at(_mean(tree.stats), levels)[_walked(bins, np.arange(n), tree.feature, tree.cut, levels)]
        moved = before + value * weight
        residual = 4.0 * sign / (1.0 + _exp(2.0 * sign * moved))
    taken = uniform(seed + part + 1, n) < share if share < 1 else np.ones(n, bool)
    return block[0], block[1], moved.tobytes(), residual.tobytes(), taken.tobytes()


def _level_sums(block: tuple, tree: Tree, level: int, nodes: np.ndarray, sizes: list[int]) -> np.ndarray:
    """(node, bin of all features, [rows, sum, sum of squares]) of the open nodes, added up in the order of the rows."""
    bins, y = _columns(*block[:2])
    residual, taken = np.frombuffer(block[3]), np.frombuffer(block[4], bool)
    slots = np.full(1 << level, len(nodes), np.int64)
    slots[nodes - ((1 << level) - 1)] = np.arange(len(nodes))
    slot = slots[_walked(bins, np.arange(len(y)), tree.feature, tree.cut, level) - ((1 << level) - 1)]
    slot[~taken] = len(nodes)
    square, out = residual * residual, []
    for f, size in enumerate(sizes):
        place, cells = slot * size + bins[f], size * (len(nodes) + 1)
        sums = [np.bincount(place, w, cells).astype(float).reshape(-1, size)[:-1] for w in (None, residual, square)]
        out.append(np.stack(sums, axis=-1))
    return np.concatenate(out, axis=1)


def _choose_variance(sums: np.ndarray, sizes: list[int], impurity: np.ndarray | None, least: int):
    """Best cut of each node, as Spark ML finds it: (feature, bin, gain, stats left, stats right, stats of the node, its impurity). The first of equal gains wins."""
    lefts, rights, where, first = [], [], [], 0
    for f, size in enumerate(sizes):
        if size > 1:
            through = np.cumsum(sums[:, first:first + size], axis=1)
            lefts.append(through[:, :-1])
            rights.append(through[:, -1:] - through[:, :-1])
            where += [(f, b) for b in range(size - 1)]
        first += size
    if not where:
        whole = sums[:, :sizes[0]].sum(axis=1)
        return None, None, np.full(len(sums), _INVALID), None, None, whole, _variance(whole)
    left, right = np.concatenate(lefts, axis=1), np.concatenate(rights, axis=1)
    whole = left[:, 0] + right[:, 0]
    if impurity is None:
        impurity = _variance(whole)
    total = left[..., 0] + right[..., 0]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = impurity[:, None] - left[..., 0] / total * _variance(left) - right[..., 0] / total * _variance(right)
    gain[(left[..., 0] < least) | (right[..., 0] < least) | ~(gain >= 0)] = _INVALID
    best, each = gain.argmax(axis=1), np.arange(len(sums))
    places = np.array(where)[best]
    return places[:, 0], places[:, 1], gain[each, best], left[each, best], right[each, best], whole, impurity


def _grow(state: RDD, depth: int, sizes: list[int], least: int) -> Tree:
    """One regression tree over the drawn rows."""
    tree, nodes, impurity = Tree.empty(depth, 3), np.zeros(1, np.int64), None
    for level in range(depth):
        slim = Tree(tree.feature, tree.cut, None, None, None, None)
        parts = state.map(lambda block, level=level, nodes=nodes: _level_sums(block, slim, level, nodes, sizes)).collect()     # the sums of a task each
        feature, bin_, gain, left, right, whole, impurity = _choose_variance(sum(parts[1:], parts[0]), sizes, impurity, least)
        if level == 0:
            tree.stats[0] = whole[0]
        tree.impurity[nodes], tree.gain[nodes] = np.where(gain == _INVALID, -1.0, impurity), gain
        cut = gain > 0
        if not cut.any():
            break
        nodes, left, right = nodes[cut], left[cut], right[cut]
        tree.feature[nodes], tree.cut[nodes], tree.split[nodes] = feature[cut], bin_[cut], True
        children = np.stack([2 * nodes + 1, 2 * nodes + 2], axis=1).reshape(-1)
        stats = np.stack([left, right], axis=1).reshape(-1, 3)
        tree.stats[children], tree.impurity[children] = stats, _variance(stats)
        is_open = np.abs(tree.impurity[children]) >= _EPSILON
        nodes, impurity = children[is_open], tree.impurity[children][is_open]
        if not len(nodes):
            break
    return tree


def fit_boosted(rows: DataFrame, n: int, estimator: GBTClassifier) -> GBTClassificationModel:
    """Spark ML's gradient boosting with logistic loss; ``rows`` holds features and a label of 0 or 1, kept by the caller."""
    spark, context = rows.sparkSession, rows.sparkSession.sparkContext
    rounds, depth, step, seed, share = (estimator.getOrDefault(x) for x in ("maxIter", "maxDepth", "stepSize", "seed", "subsamplingRate"))
    cuts = thresholds(rows, n, rows.first()["features"].size, estimator.getMaxBins(), seed, (1.0, 1.0), float(n))
    sizes = [len(x) + 1 for x in cuts]
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    state, written, trees = packed(rows, cuts), [], []
    for m in range(rounds):
        last, weight = (trees[-1], 1.0 if m == 1 else step) if trees else (None, 0.0)

        def draw(part: int, blocks, last=last, weight=weight, m=m):
            return (_drawn(block, seed + m, share, last, weight, depth, part) for block in blocks)

        drawn = state.mapPartitionsWithIndex(draw).persist(StorageLevel.MEMORY_AND_DISK)
        if m % CHECKPOINT_ROUNDS == CHECKPOINT_ROUNDS - 1:
            drawn.checkpoint()
        trees.append(_grow(drawn, depth, sizes, estimator.getMinInstancesPerNode()))
        state.unpersist()
        state = drawn
        if drawn.getCheckpointFile():       # the one before isn't read any more
            written.append(drawn.getCheckpointFile())
            for path in written[-2:-1]:
                remove_path(spark, path)
    state.unpersist()
    for path in written[-1:]:
        remove_path(spark, path)
    return _model(spark, GBTClassificationModel, estimator, trees, cuts, [1.0] + [step] * (rounds - 1), depth, _mean)


# -- the forest ------------------------------------------------------------------------------------
_POISSON = np.cumsum([np.exp(-1.0) / np.prod(np.arange(1.0, k + 1)) for k in range(13)])       # 13 and more: less than 2^-32


def _bootstrap(seed: int, tree: int, part: int, n: int) -> np.ndarray:
    """How often each row of a partition takes part in a tree: Poisson of mean 1."""
    draws = np.random.Generator(np.random.SFC64([seed & _MASK, tree, part])).integers(0, 1 << 32, n, np.uint32)
    counts = np.zeros(n, np.uint8)
    for limit in (_POISSON * 2.0 ** 32):
        if limit < 2.0 ** 32 - 1:
            counts += draws >= np.uint32(limit)
    return counts


def _subsets(seed: int, tree: int, level: int, nodes: int, width: int, size: int) -> np.ndarray:
    """``size`` of ``width`` features for each node, every choice and order as likely as any other (Floyd's way): the first of equal gains wins."""
    draw = np.random.Generator(np.random.SFC64([seed & _MASK, tree, level, 7]))
    chosen = np.full((nodes, size), -1, np.int64)
    for i, top in enumerate(range(width - size, width)):
        pick = draw.integers(0, top + 1, nodes)
        chosen[:, i] = np.where((chosen == pick[:, None]).any(axis=1), top, pick)
    return np.take_along_axis(chosen, draw.random(chosen.shape).argsort(axis=1), axis=1)


def _tree_sums(block: tuple, part: int, tree: int, seed: int, level: int, feature: np.ndarray, cut: np.ndarray, nodes: np.ndarray,
               subsets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Rows by (feature slot, open node, bin of its feature, class) of one tree."""
    bins, y = _columns(*block)
    counts = _bootstrap(seed, tree, part, len(y))
    rows = np.flatnonzero(counts)
    slots = np.full(1 << level, -1, np.int64)
    slots[nodes - ((1 << level) - 1)] = np.arange(len(nodes))
    slot = slots[_walked(bins, rows, feature, cut, level) - ((1 << level) - 1)]
    rows, slot = rows[slot >= 0], slot[slot >= 0]
    weight, kind, flat, out = counts[rows].astype(float), (y[rows] == 1).astype(np.int64), bins.reshape(-1), []
    for j in range(subsets.shape[1]):
        chosen = subsets[:, j]
        ends = np.cumsum(2 * sizes[chosen])
        start = ends - 2 * sizes[chosen]
        place = flat[(chosen * len(y))[slot] + rows] * np.int64(2)
        place += start[slot]
        place += kind
        out.append(np.bincount(place, weight, ends[-1] if len(ends) else 0).astype(np.int64))
    return np.concatenate(out)


def _gini(s: np.ndarray) -> np.ndarray:
    total = s.sum(axis=-1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(total == 0, 0.0, 1.0 - ((s / total[..., None]) ** 2).sum(axis=-1))


def _choose_gini(sums: np.ndarray, subsets: np.ndarray, sizes: np.ndarray, weights: np.ndarray, least: int) -> np.ndarray:
    """Rows (feature, bin, gain, rows of both classes left, right) of the nodes; the first feature and bin of equal gains wins."""
    nodes, best = len(subsets), np.zeros((len(subsets), 7))
    best[:, 2] = _INVALID
    first = 0
    for j in range(subsets.shape[1]):
        size = sizes[subsets[:, j]]
        widest = int(size.max())
        start = first + np.cumsum(2 * size) - 2 * size
        first += int(2 * size.sum())
        inside = np.arange(widest) < size[:, None]
        cells = np.where(inside[..., None], sums[np.where(inside, start[:, None] + 2 * np.arange(widest), 0)[..., None] + np.arange(2)], 0)
        through = cells.cumsum(axis=1)
        whole = through[:, -1]
        if j == 0:
            best[:, 3:5], best[:, 5:] = whole, 0
        left, right = through[:, :-1], whole[:, None] - through[:, :-1]
        if not left.shape[1]:
            continue
        wl, wr = left * weights, right * weights
        nl, nr = wl.sum(axis=-1), wr.sum(axis=-1)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = _gini(whole * weights)[:, None] - nl / (nl + nr) * _gini(wl) - nr / (nl + nr) * _gini(wr)
        invalid = (left.sum(axis=-1) < least) | (right.sum(axis=-1) < least) | ~(gain >= 0) | (np.arange(widest - 1) >= size[:, None] - 1)
        gain[invalid] = _INVALID
        at, each = gain.argmax(axis=1), np.arange(nodes)
        top = gain[each, at]
        better = top > best[:, 2]
        found = np.column_stack([subsets[:, j], at, top, left[each, at], right[each, at]])
        best[better] = found[better]
    return best


def fit_forest(rows: DataFrame, n: int, estimator: RandomForestClassifier, weights: tuple[float, float], weight_sum: float) -> RandomForestClassificationModel:
    """A random forest with Gini impurity, bootstrap and a fresh choice of sqrt(features) at each node; ``weights`` are those of classes 0 and 1."""
    spark, context = rows.sparkSession, rows.sparkSession.sparkContext
    count, depth, seed, least = (estimator.getOrDefault(x) for x in ("numTrees", "maxDepth", "seed", "minInstancesPerNode"))
    width = rows.first()["features"].size
    cuts = thresholds(rows, n, width, estimator.getMaxBins(), seed, weights, weight_sum)
    sizes, each = np.array([len(x) + 1 for x in cuts]), int(np.ceil(np.sqrt(width)))
    blocks, by_class = packed(rows, cuts), np.array(weights)
    trees = [Tree.empty(depth, 3) for _ in range(count)]
    frontier = {t: np.zeros(1, np.int64) for t in range(count)}
    for level in range(depth):
        plan = {t: (trees[t].feature[:(1 << level) - 1].astype(np.int32), trees[t].cut[:(1 << level) - 1], nodes,
                    _subsets(seed, t, level, len(nodes), width, each)) for t, nodes in frontier.items()}
        sent = context.broadcast(plan)

        def sums(part: int, parts, level=level, sent=sent):
            for block in parts:
                for t, (feature, cut, nodes, subsets) in sent.value.items():
                    yield t, _tree_sums(block, part, t, seed, level, feature.astype(np.int64), cut, nodes, subsets, sizes)

        def chosen(pairs, sent=sent):
            whole: dict[int, np.ndarray] = {}
            for t, x in pairs:
                whole[t] = whole[t] + x if t in whole else x
            for t, x in whole.items():
                yield t, _choose_gini(x, sent.value[t][3], sizes, by_class, least)

        spread_out = min(len(frontier), 2 * context.defaultParallelism)
        found = blocks.mapPartitionsWithIndex(sums).partitionBy(spread_out).mapPartitions(chosen).collect()       # a row per node
        frontier = {}
        for t, best in found:
            tree, nodes = trees[t], plan[t][2]
            left, right = best[:, 3:5], best[:, 5:]
            if level == 0:
                tree.stats[0] = [*((left + right)[0] * by_class), (left + right).sum()]
                tree.impurity[0] = _gini(tree.stats[:1, :2])[0]
            gain = best[:, 2]
            tree.gain[nodes] = gain
            tree.impurity[nodes] = np.where(gain == _INVALID, -1.0, tree.impurity[nodes])
            cut = gain > 0
            nodes = nodes[cut]
            tree.feature[nodes], tree.cut[nodes], tree.split[nodes] = best[cut, 0], best[cut, 1], True
            children = np.stack([2 * nodes + 1, 2 * nodes + 2], axis=1).reshape(-1)
            raw = np.stack([left[cut], right[cut]], axis=1).reshape(-1, 2)
            tree.stats[children] = np.column_stack([raw * by_class, raw.sum(axis=1)])
            tree.impurity[children] = _gini(tree.stats[children, :2])
            still = children[np.abs(tree.impurity[children]) >= _EPSILON]
            if len(still):
                frontier[t] = still
        sent.unpersist()
        if not frontier:
            break
    blocks.unpersist()
    return _model(spark, RandomForestClassificationModel, estimator, trees, cuts, [1.0] * count, depth,
                  lambda s: (s[..., 1] > s[..., 0]).astype(float))


# -- Spark's models --------------------------------------------------------------------------------
def _nodes(tree: Tree, prediction: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places in the heap in preorder, left child, right child by number in it); two leaves that predict the same are one."""
    leaf = ~tree.split
    value = prediction.copy()
    for level in range(depth - 1, -1, -1):
        at = np.arange((1 << level) - 1, (1 << level + 1) - 1)
        at = at[tree.split[at]]
        same = at[leaf[2 * at + 1] & leaf[2 * at + 2] & (value[2 * at + 1] == value[2 * at + 2])]
        leaf[same], value[same] = True, value[2 * same + 1]
    order, left, right, todo = [], [], [], [(0, -1)]
    while todo:
        i, parent = todo.pop()
        if parent >= 0:
            right[parent] = len(order)
        order.append(i)
        left.append(-1 if leaf[i] else len(order))
        right.append(-1)
        if not leaf[i]:
            todo += [(2 * i + 2, len(order) - 1), (2 * i + 1, -1)]
    return np.array(order), np.array(left), np.array(right), value


def _node_table(trees: list[Tree], cuts: list[np.ndarray], depth: int, predict) -> pa.Table:
    """Spark ML's table of nodes."""
    columns: dict[str, list] = {x: [] for x in ("tree", "id", "prediction", "impurity", "stats", "raw", "gain", "left", "right", "feature", "threshold")}
    offsets = np.cumsum([0, *map(len, cuts)])
    flat = np.concatenate([*cuts, [0.0]])
    for t, tree in enumerate(trees):
        places, left, right, value = _nodes(tree, predict(tree.stats), depth)
        inner = left >= 0
        feature = np.where(inner, tree.feature[places], -1)
        shown = tree.stats[places]
        variance = predict is _mean
        threshold = flat[np.where(inner, offsets[feature] + tree.cut[places], 0)]
        for name, x in (("tree", np.full(len(places), t)), ("id", np.arange(len(places))), ("prediction", value[places]), ("impurity", tree.impurity[places]),
                        ("stats", shown if variance else shown[:, :2]), ("raw", shown[:, 0 if variance else 2]), ("gain", np.where(inner, tree.gain[places], -1.0)),
                        ("left", left), ("right", right), ("feature", feature), ("threshold", threshold)):
            columns[name].append(x)
    all_of = {name: np.concatenate(x) for name, x in columns.items()}
    count, wide = len(all_of["id"]), all_of["stats"].shape[1]
    ends = np.concatenate([[0], np.cumsum(all_of["feature"] >= 0)]).astype(np.int32)
    split = pa.StructArray.from_arrays([
        pa.array(all_of["feature"], pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(all_of["threshold"][all_of["feature"] >= 0], pa.float64())),
        pa.array(np.full(count, -1), pa.int32())], ["featureIndex", "leftCategoriesOrThreshold", "numCategories"])
    stats = pa.ListArray.from_arrays(pa.array(np.arange(0, count * wide + 1, wide, dtype=np.int32)), pa.array(all_of["stats"].reshape(-1)))
    data = pa.StructArray.from_arrays([
        pa.array(all_of["id"], pa.int32()), pa.array(all_of["prediction"]), pa.array(all_of["impurity"]), stats, pa.array(all_of["raw"].astype(np.int64)),
        pa.array(all_of["gain"]), pa.array(all_of["left"], pa.int32()), pa.array(all_of["right"], pa.int32()), split],
        ["id", "prediction", "impurity", "impurityStats", "rawCount", "gain", "leftChild", "rightChild", "split"])
    return pa.Table.from_arrays([pa.array(all_of["tree"], pa.int32()), data], ["treeID", "nodeData"])


def _model(spark: SparkSession, kind, estimator, trees: list[Tree], cuts: list[np.ndarray], weights: list[float], depth: int, predict):
    """The model that Spark ML reads from its own format, with the estimator's parameters."""
    path, single = work_path(spark, "ensemble"), "regression.DecisionTreeRegressionModel" if kind is GBTClassificationModel else "classification.DecisionTreeClassificationModel"
    estimator.write().overwrite().save(f"{path}/estimator")
    meta = json.loads(spark.read.text(f"{path}/estimator/metadata").first()["value"])
    meta |= {"class": f"org.apache.spark.ml.classification.{kind.__name__}", "numFeatures": len(cuts), "numTrees": len(trees)}
    if kind is RandomForestClassificationModel:
        meta["numClasses"] = 2
    kept = {x: meta[y].get(x) for y in ("defaultParamMap", "paramMap") for x in ("featuresCol", "labelCol", "maxDepth", "seed") if x in meta[y]}
    each = {x: meta[x] for x in ("timestamp", "sparkVersion")} | {"class": f"org.apache.spark.ml.{single}", "paramMap": kept, "defaultParamMap": {}}
    rows = [(t, json.dumps(each | {"uid": f"tree_{uuid.uuid4().hex[:12]}"}), float(w)) for t, w in enumerate(weights)]
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.text(f"{path}/model/metadata")
    spark.createDataFrame(rows, "_1 int, _2 string, _3 double").write.parquet(f"{path}/model/treesMetadata")
    spark.createDataFrame(_node_table(trees, cuts, depth, predict)).write.parquet(f"{path}/model/data")
    model = kind.load(f"{path}/model")
    remove_path(spark, path)
    return model


# -- scores ----------------------------------------------------------------------------------------
@dataclass
class Nodes:
    """The nodes of all trees: of tree t from ``starts[t]`` on, children by number in their tree; a leaf is its own child."""

    starts: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    child: np.ndarray               # left and right, side by side
    value: np.ndarray
    weights: list[float]
    depth: int


def _nodes_of(model) -> Nodes:
    """Read from the model as it is saved."""
    spark, boosted = SparkSession.active(), isinstance(model, GBTClassificationModel)
    path = work_path(spark, "nodes")
    model.write().overwrite().save(path)
    stats = F.col("nodeData.impurityStats")
    table = spark.read.parquet(f"{path}/data").select(
        "treeID", "nodeData.id", "nodeData.leftChild", "nodeData.rightChild", "nodeData.split.featureIndex",
        F.get("nodeData.split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"),
        (F.col("nodeData.prediction") if boosted else F.try_divide(stats[1], stats[0] + stats[1])).alias("value")).toArrow()
    remove_path(spark, path)
    tree, number, left, right, feature, threshold, value = (x.to_numpy() for x in table.columns)
    order = np.lexsort((number, tree))
    leaf, number = left[order] < 0, number[order]
    starts = np.searchsorted(tree[order], np.arange(model.getNumTrees + 1))
    children = np.stack([np.where(leaf, number, left[order]), np.where(leaf, number, right[order])], axis=1).reshape(-1)
    return Nodes(starts, np.where(leaf, 0, feature[order]).astype(np.int64), np.nan_to_num(threshold[order]), children.astype(np.int64),
                 np.nan_to_num(value[order]), list(model.treeWeights), model.getOrDefault("maxDepth"))


def _summed(values: np.ndarray, nodes: Nodes) -> np.ndarray:
    """The weighted sum over all trees of the values of the leaves that the rows come to."""
    n, width = values.shape
    flat, first, total = values.reshape(-1), np.arange(n) * width, np.zeros(n)
    for t, weight in enumerate(nodes.weights):
        part = slice(nodes.starts[t], nodes.starts[t + 1])
        feature, threshold, value = nodes.feature[part], nodes.threshold[part], nodes.value[part]
        child, at = nodes.child[2 * part.start:2 * part.stop], np.zeros(n, np.int64)
        for _ in range(nodes.depth):
            more = ~(flat[first + feature[at]] <= threshold[at])
            at *= 2
            at += more
            at = child[at]
        total += weight * value[at]
    return total


def scores(model, features: str = "features") -> tuple[Column, Column]:
    """Raw prediction and probability of class 1 of Spark ML's tree ensembles, as columns: each batch of rows goes through all trees once."""
    if not hasattr(model, "_sent_nodes"):
        model._sent_nodes = SparkSession.active().sparkContext.broadcast(_nodes_of(model))
    sent = model._sent_nodes

    @F.arrow_udf("double")
    def raw(vectors: pa.Array) -> pa.Array:
        return pa.array(_summed(vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1), sent.value))

    found = raw(vector_to_array(features))
    if isinstance(model, GBTClassificationModel):
        return found, 1.0 - 1.0 / (1.0 + F.exp(2.0 * found))
    return found, found / model.getNumTrees
