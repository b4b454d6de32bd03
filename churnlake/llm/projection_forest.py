"""Near-duplicate vectors by a forest of random-projection trees with spill overlap.

A node is split by a random direction where few points lie near the cut (between the quarters of its sample), and points within
``MARGIN`` of the cut go to both sides. Splits are fitted on at most ``SAMPLE`` vectors of a node and route all its vectors, in slices of about
as many, each of which meets one copy of the node's tree; nodes that are still large are split again in the next round, by tasks of their
own, so neither the driver nor a task sees more than a sample. A node whose
points lie so near together that a cut would send nearly all to both sides becomes a leaf whatever its size; leaves above
``BLOCK`` vectors are compared in tiles of two blocks.

Equal vectors are one, with a weight. Within a leaf all pairs are compared by cosine in double precision. A pair that shares several
leaves counts in the first of them only, so links are counted without writing pairs: a leaf gives its vectors' counts and a spanning
link for each, and the components of these are those of all links found.

Vectors that are null, empty or zero, or hold null or non-finite components, link with nothing; vectors of different dimension don't
link. A pair is missed only if every tree parts it: two vectors at cosine 0.95 or more differ by at most 0.32, and by more than twice
the margin along a random direction of 64 or more dimensions in few cases.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from churnlake.llm.components import components
from churnlake.llm.tables import kept_table, read_table
from churnlake.session import finished

LEAST_COSINE = 0.95
TREES = 4
LEAF = 400              # vectors in a leaf, about
SAMPLE = 8192           # vectors that the splits of a node are fitted on
MARGIN = 0.035          # half width of the overlap, for unit vectors
DIRECTIONS = 8          # tried for a split
BLOCK = 1024
_ROUNDS = 12


def _matrix(values: list[bytes], width: int) -> np.ndarray:
    """Unit vectors in double precision; ``width`` is the number of bytes a component is stored in."""
    x = np.frombuffer(b"".join(values), f"<f{width}").reshape(len(values), -1).astype("<f8")
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _split(x: np.ndarray, rng: np.random.Generator):
    """direction and cut with least spill; None where a cut would part nothing."""
    best = None
    for _ in range(DIRECTIONS):
        direction = rng.standard_normal(x.shape[1])
        direction /= np.linalg.norm(direction)
        along = np.sort(x @ direction)
        cuts = along[np.linspace(len(x) // 4, 3 * len(x) // 4, 9).astype(int)]
        spill = np.searchsorted(along, cuts + MARGIN, "right") - np.searchsorted(along, cuts - MARGIN)
        larger = np.maximum(np.searchsorted(along, cuts + MARGIN, "right"), len(x) - np.searchsorted(along, cuts - MARGIN))
        i = int(np.argmin(spill + larger))
        if best is None or spill[i] + larger[i] < best[0]:
            best = (spill[i] + larger[i], larger[i], direction, float(cuts[i]))
    return None if best[1] > 0.9 * len(x) else best[2:]


def fit_tree(x: np.ndarray, leaf: float, rng: np.random.Generator):
    """Nested (direction, cut, left, right); a leaf is True if it must not be split again, else False."""
    if len(x) <= max(leaf, 16):
        return False
    found = _split(x, rng)
    if found is None:
        return True
    direction, cut = found
    along = x @ direction
    return (direction, cut, fit_tree(x[along <= cut + MARGIN], leaf, rng), fit_tree(x[along >= cut - MARGIN], leaf, rng))


def route(tree, x: np.ndarray, rows: np.ndarray, name: str):
    """(leaf name, rows) of the leaves that the vectors reach; final leaves end in '!'."""
    if not len(rows):
        return
    if isinstance(tree, bool):
        yield name + ("!" if tree else ""), rows
        return
    direction, cut, left, right = tree
    along = x[rows] @ direction
    yield from route(left, x, rows[along <= cut + MARGIN], name + "0")
    yield from route(right, x, rows[along >= cut - MARGIN], name + "1")


def leaves(vectors: DataFrame, width: int) -> DataFrame:
    """row and leaf for rows (row, vec, dims): every leaf of every tree that a vector reaches."""
    def fit(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        name = key[0]
        share = len(frame) / frame["n"].iloc[0]
        seed = int.from_bytes(name.encode()[-6:], "little")
        tree = fit_tree(_matrix(frame["vec"].tolist(), width), LEAF * share, np.random.default_rng(seed))
        # a node that no round makes smaller is compared as it is
        return pd.DataFrame({"leaf": [name], "tree": [pickle.dumps(True if tree is False else tree)]})

    def routed(key: tuple, frame: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
        if not len(frame):
            return pd.DataFrame({"row": [], "leaf": []}).astype({"row": "int64", "leaf": "object"})
        x, row = _matrix(frame["vec"].tolist(), width), frame["row"].to_numpy()
        got = list(route(pickle.loads(trees["tree"].iloc[0]), x, np.arange(len(x)), key[0]))
        return pd.DataFrame({"row": row[np.concatenate([at for _, at in got])],
                             "leaf": np.repeat(np.array([name for name, _ in got], object), [len(at) for _, at in got])})

    pending = vectors.select("row", F.explode(F.transform(
        F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.concat_ws(":", "dims", t, F.lit("")))).alias("leaf"))
    pending, done = kept_table(pending, "forest-leaves"), []
    slices = F.ceil(F.col("n") / SAMPLE).cast("int")
    for _ in range(_ROUNDS):
        sizes = kept_table(pending.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")), "forest-sizes")
        large = sizes.where((F.col("n") > LEAF) & ~F.col("leaf").endswith("!"))
        done.append(pending.join(sizes.where((F.col("n") <= LEAF) | F.col("leaf").endswith("!")), "leaf").select("row", "leaf"))
        if large.isEmpty():
            break
        placed = pending.join(large, "leaf").join(vectors.select("row", "vec"), "row")
        picked = placed.where(F.pmod(F.xxhash64("row", "leaf"), F.lit(1 << 40)) < F.lit(SAMPLE * (1 << 40)) / F.col("n"))
        trees = kept_table(picked.select("leaf", "n", "vec").groupBy("leaf").applyInPandas(fit, "leaf string, tree binary"), "forest-trees")
        copies = trees.join(large, "leaf").select("leaf", F.explode(F.sequence(F.lit(0), slices - 1)).alias("slice"), "tree")
        parts = placed.select("leaf", F.pmod(F.xxhash64("row"), slices).cast("int").alias("slice"), "row", "vec")
        pending = kept_table(parts.groupBy("leaf", "slice").cogroup(copies.groupBy("leaf", "slice")).applyInPandas(
            routed, "row long, leaf string"), "forest-leaves")
    else:
        done.append(pending)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select("row", F.xxhash64("leaf").alias("leaf"))


def _first_shared(a: np.ndarray, b: np.ndarray, leaf: int) -> np.ndarray:
    """Whether ``leaf`` is the least id that the rows of two padded id matrices share."""
    out = np.ones(len(a), bool)
    for k in range(a.shape[1]):
        known = (a[:, k] < leaf) & out
        if known.any():
            at = np.flatnonzero(known)
            out[at] = ~(b[at] == a[at, k][:, None]).any(axis=1)
    return out


def _compare(key: tuple, frame: pd.DataFrame, width: int) -> pd.DataFrame:
    """row, links (weighted) and root (a spanning link) of the linked vectors of a tile."""
    leaf, first, second = key
    left = frame[frame["block"] == first]
    right = left if first == second else frame[frame["block"] == second]
    if not len(left) or not len(right):
        return pd.DataFrame({"row": [], "links": [], "root": []}).astype("int64")
    cosine = _matrix(left["vec"].tolist(), width) @ _matrix(right["vec"].tolist(), width).T
    i, j = np.nonzero(np.triu(cosine >= LEAST_COSINE, 1) if first == second else cosine >= LEAST_COSINE)

    def padded(side):
        ids = side["leaves"].tolist()
        out = np.full((len(ids), max(map(len, ids))), np.iinfo(np.int64).max)
        for n, x in enumerate(ids):
            out[n, :len(x)] = x
        return out

    own = np.concatenate([_first_shared(a[i[k:k + 65536]], b[j[k:k + 65536]], leaf) for a, b in [(padded(left), padded(right))]
                          for k in range(0, max(1, len(i)), 65536)]) if len(i) else np.zeros(0, bool)
    i, j = i[own], j[own]
    rows_a, rows_b = left["row"].to_numpy(), right["row"].to_numpy()
    ends, at = np.unique(np.concatenate([rows_a[i], rows_b[j]]), return_inverse=True)
    a, b = at[:len(i)], at[len(i):]
    links = np.bincount(a, right["weight"].to_numpy()[j], len(ends)) + np.bincount(b, left["weight"].to_numpy()[i], len(ends))
    root = np.arange(len(ends))
    while len(a):       # least end of the links, by repeated minimum and pointer jumping
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return pd.DataFrame({"row": ends, "links": links.astype(np.int64), "root": ends[root] if len(ends) else ends})


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id and kept for rows (vec_id, embedding)."""
    item = F.col("embedding")
    number = F.transform(item, lambda x: x.cast("double"))
    good = F.coalesce(F.size(item) > 0, F.lit(False)) & F.coalesce(F.forall(
        item, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))), F.lit(False)) \
        & F.coalesce(F.exists(item, lambda x: x != 0), F.lit(False))
    listed = vectors.select("vec_id", F.when(good, number).alias("embedding"))
    width = 4 if vectors.schema["embedding"].dataType.elementType == FloatType() else 8     # floats are stored as they come

    def packed(batches):
        for batch in batches:
            values = [None if x is None else np.array(x, f"<f{width}").tobytes() for x in batch.column("embedding").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(values, pa.binary())], ["vec_id", "vec"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    rows = kept_table(listed.mapInArrow(packed, f"vec_id {kind}, vec binary"), "forest-rows")
    distinct = rows.where(F.col("vec").isNotNull()).groupBy("vec").agg(
        F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("least"))
    distinct = kept_table(distinct.withColumn("row", F.monotonically_increasing_id()).withColumn(
        "dims", F.octet_length("vec") / width), "forest-vectors")
    reached = finished(vectors.sparkSession, "forest-reached", lambda: leaves(
        distinct.select("row", "vec", F.col("dims").cast("int").alias("dims")), width).distinct())
    tiles = reached.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    lists = reached.groupBy("row").agg(F.sort_array(F.collect_set("leaf")).alias("leaves"))     # a few dozen of a vector
    met = reached.join(tiles, "leaf").join(lists, "row").join(distinct.select("row", "vec", "weight"), "row")
    met = met.withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    met = met.select("row", "leaf", "vec", "weight", "leaves", "block", other)
    met = met.withColumn("first", F.least("block", "other")).withColumn("second", F.greatest("block", "other"))

    def compared(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return _compare(key, frame, width)

    found = kept_table(met.groupBy("leaf", "first", "second").applyInPandas(compared, "row long, links long, root long"), "forest-links")
    counts = found.groupBy("row").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("row").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("row"), "component")
    named = distinct.select("row", "vec", "weight", "least").join(counts, "row", "left").join(groups, "row", "left").withColumn(
        "component", F.coalesce("component", "row"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = kept_table(named.join(least, "component").select(
        "vec", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id"), "forest-named")
    out = rows.join(named, "vec").select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id")
    out = out.union(rows.where(F.col("vec").isNull()).select("vec_id", F.lit(0).cast("long"), "vec_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op4_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return finished(spark, "forest-result", lambda: near_duplicates(vectors))
