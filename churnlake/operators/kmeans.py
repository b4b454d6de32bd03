"""Lloyd's k-means for many starts at a time.

An iteration reads the table once: each task finds the nearest centres of its rows, which are packed in blocks, for all starts that still move, and sends
its sums by (start, cluster); one aggregate adds them up. Only these, starts x clusters of them, reach the driver, which moves the centres. A start
rests when none of its centres moves more than ``TOLERANCE``; the cheapest start of all wins, the first on a tie.

First centres are drawn by k-means++ from at most ``SEED_ROWS`` rows with the smallest hashes, whatever the size of the table; everything
after that is over all rows. A cluster that loses all its rows keeps its centre.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

SEED_ROWS = 2000
TOLERANCE = 1e-4
_TILE = 2048                    # rows whose distances to all centres are in memory at a time


@dataclass
class Clusters:
    """Centres and the summed squared distance of the rows they were fitted on."""

    centers: list[list[float]]
    cost: float

    def nearest(self, values: list[Column]) -> Column:
        """Number of the nearest centre, the first on a tie."""
        return _nearest([[F.lit(x) for x in center] for center in self.centers], values)[0]


def _nearest(centers: list[list[Column]], values: list[Column]) -> tuple[Column, Column]:
    distances = []
    for center in centers:
        far = F.lit(0.0)
        for x, v in zip(center, values):
            far = far + (v - x) * (v - x)
        distances.append(far)
    best = F.least(*distances) if len(distances) > 1 else distances[0]
    number = F.lit(len(distances) - 1)
    for j in range(len(distances) - 2, -1, -1):
        number = F.when(distances[j] == best, j).otherwise(number)
    return number, best


def _first_centers(rows: np.ndarray, k: int, seed: int) -> list[list[float]]:
    """k-means++: each next centre is drawn by squared distance to those there are."""
    draw = np.random.default_rng(seed)
    centers = [rows[draw.integers(len(rows))]]
    while len(centers) < k:
        far = np.min([((rows - x) ** 2).sum(axis=1) for x in centers], axis=0)
        total = far.sum()
        centers.append(rows[draw.choice(len(rows), p=far / total) if total > 0 else draw.integers(len(rows))])
    return [[float(v) for v in x] for x in centers]


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The doubles of each batch, column after column, as one binary value: passes needn't turn rows into batches again."""
    for batch in batches:
        if batch.num_rows:
            values = np.stack([x.to_numpy(zero_copy_only=False) for x in batch.columns])
            yield pa.RecordBatch.from_arrays([pa.array([values.tobytes()], pa.binary())], ["block"])


def _nearest_sums(batches: Iterator[pa.RecordBatch], starts: list[int], centers: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One task's (start, cluster, rows, cost, sums of the columns) of packed blocks. ``centers`` is starts x clusters x columns; distances add up
    in the order of the columns, as those of ``Clusters.nearest`` do, and the first centre wins a tie."""
    count, k, width = centers.shape
    sums = np.zeros((count, k, width + 2))
    for block in (value.as_buffer() for batch in batches for value in batch.column(0)):
        values = np.frombuffer(block).reshape(width, -1)
        for first in range(0, values.shape[1], _TILE):
            rows = values[:, first:first + _TILE]
            far = np.zeros((count, k, rows.shape[1]))
            for i in range(width):
                far += (rows[i] - centers[:, :, i, None]) ** 2
            found = far.argmin(axis=1)
            best = np.take_along_axis(far, found[:, None, :], axis=1)[:, 0]
            for s in range(count):
                for i, weights in enumerate([None, best[s], *rows]):        # no weights: the rows themselves
                    sums[s, :, i] += np.bincount(found[s], weights, k)
    used = [(s, j) for s in range(count) for j in range(k) if sums[s, j, 0]]
    yield pa.RecordBatch.from_arrays(
        [pa.array([starts[s] for s, _ in used], pa.int32()), pa.array([j for _, j in used], pa.int32()),
         pa.array([int(sums[s, j, 0]) for s, j in used], pa.int64()),
         *[pa.array([sums[s, j, i] for s, j in used], pa.float64()) for i in range(1, width + 2)]],
        ["start", "cluster", "n", "cost", *[f"sum{i}" for i in range(width)]])


class _Pass:
    """One scan: (rows, cost, sums of the columns) by start and cluster, a row per task and pair before they are summed."""

    def __init__(self, matrix: DataFrame):
        self.blocks = matrix.mapInArrow(_packed, "block binary").persist(StorageLevel.MEMORY_AND_DISK)
        sums = [f"sum{i}" for i in range(len(matrix.columns))]
        self.schema = "start int, cluster int, n long, cost double, " + ", ".join(f"{x} double" for x in sums)
        self.sums = [F.sum(x).alias(x) for x in ["n", "cost", *sums]]

    def __call__(self, centers: dict[int, list[list[float]]]) -> dict[tuple[int, int], tuple]:
        starts, places = list(centers), np.array(list(centers.values()), float)
        found = self.blocks.mapInArrow(lambda batches: _nearest_sums(batches, starts, places), self.schema)
        sums = found.groupBy("start", "cluster").agg(*self.sums)
        return {(r["start"], r["cluster"]): (r["n"], r["cost"], list(r[4:])) for r in sums.collect()}      # starts x k rows


def all_starts(matrix: DataFrame, k: int, starts: int, iterations: int, seed: int) -> list[Clusters]:
    """Every start, fitted; ``matrix`` holds nothing but columns of doubles."""
    chosen = matrix.orderBy(F.xxhash64(*matrix.columns)).limit(SEED_ROWS).collect()
    if not chosen:
        raise ValueError("no rows to cluster")
    rows = np.array([tuple(r) for r in chosen], float)
    centers = {s: _first_centers(rows, k, seed + s) for s in range(starts)}
    moving, sums_of = set(centers), _Pass(matrix)
    for _ in range(iterations):
        sums = sums_of({s: centers[s] for s in sorted(moving)})
        for s in sorted(moving):
            old = centers[s]
            centers[s] = [[x / sums[s, j][0] for x in sums[s, j][2]] if (s, j) in sums else old[j] for j in range(k)]
            if max(sum((a - b) ** 2 for a, b in zip(x, y)) for x, y in zip(old, centers[s])) <= TOLERANCE ** 2:
                moving.discard(s)
        if not moving:
            break
    final = sums_of(centers)
    sums_of.blocks.unpersist()
    return [Clusters(centers[s], sum(c for (start, _), (_, c, _) in final.items() if start == s)) for s in sorted(centers)]


def best_clusters(matrix: DataFrame, k: int, starts: int, iterations: int, seed: int) -> Clusters:
    return min(all_starts(matrix, k, starts, iterations, seed), key=lambda x: x.cost)
