"""Trees over packed blocks against Spark ML's."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from churnlake.operators import training, trees


@pytest.fixture(scope="module")
def table(spark):
    """Two numbers, flags, two flags that say the same, one that says the opposite, and a column without values."""
    draw = np.random.default_rng(5)
    rows = []
    for _ in range(700):
        a, b, flags = draw.normal(), float(draw.integers(0, 60)), draw.integers(0, 2, 3)
        label = float((a > 0.3) + (b > 30) + flags[0] >= 2) if draw.random() > 0.1 else float(draw.integers(0, 2))
        values = np.array([a, b, *flags, flags[0], 1 - flags[0], 0.0])
        places = np.flatnonzero(values)
        rows.append((Vectors.sparse(8, places.tolist(), values[places].tolist()) if flags[1] else Vectors.dense(values.tolist()), label))
    return spark.createDataFrame(rows, ["features", "label"]).repartition(2).persist()


def test_boosting_is_sparks(table):
    estimator = GBTClassifier(maxIter=28, maxDepth=4, stepSize=0.1, subsamplingRate=0.8, seed=3)        # past a checkpoint
    mine, theirs = trees.fit_boosted(table, table.count(), estimator), estimator.fit(table)
    assert mine.totalNumNodes == theirs.totalNumNodes and mine.treeWeights == theirs.treeWeights
    assert mine.featureImportances.toArray() == pytest.approx(theirs.featureImportances.toArray(), abs=1e-9)
    p, q = ([r.probability[1] for r in m.transform(table).select("probability").collect()] for m in (mine, theirs))
    assert p == pytest.approx(q, abs=1e-9)
    assert mine.getMaxDepth() == 4 and mine.numFeatures == 8


def test_exponential_and_draws_are_the_jvms(spark):
    x = np.concatenate([np.random.default_rng(1).normal(size=3000) * s for s in (1e-9, 1.0, 40.0)] + [[0.0, -800.0, 800.0]])
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    strict = np.array([r[0] for r in df.selectExpr("java_method('java.lang.StrictMath', 'exp', x)").collect()], float)
    assert (trees._exp(x) == strict).all()
    generator = spark._jvm.org.apache.spark.util.random.XORShiftRandom(43)
    assert trees.uniform(43, 50).tolist() == [generator.nextDouble() for _ in range(50)]


def test_forest_like_sparks(table):
    n, weights = table.count(), training.class_weights(table)[0]
    weighted = training.with_class_weight(table)[0]
    estimator = RandomForestClassifier(numTrees=60, maxDepth=6, minInstancesPerNode=4, featureSubsetStrategy="sqrt", seed=3, weightCol="weight")
    mine, theirs = trees.fit_forest(table, n, estimator, weights, float(n)), estimator.fit(weighted)
    assert mine.getNumTrees == 60 and sum(mine.featureImportances.toArray()) == pytest.approx(1.0)
    assert mine.totalNumNodes == pytest.approx(theirs.totalNumNodes, rel=0.1)
    assert mine.featureImportances.toArray() == pytest.approx(theirs.featureImportances.toArray(), abs=0.06)
    p, q = (np.array([r.probability[1] for r in m.transform(table).select("probability").collect()]) for m in (mine, theirs))
    assert abs(p - q).mean() < 0.03 and np.corrcoef(p, q)[0, 1] > 0.98


def test_a_tree_of_all_features_by_hand(spark):
    """With every feature at each node and no choice among rows, the forest's sums and cuts are those of a plain search."""
    counts = np.stack([trees._bootstrap(7, t, 0, 4000) for t in range(5)])
    assert counts.mean() == pytest.approx(1.0, abs=0.03) and counts.var() == pytest.approx(1.0, abs=0.06)
    picks = trees._subsets(7, 0, 3, 6000, 8, 3)
    assert (np.diff(np.sort(picks, axis=1), axis=1) > 0).all() and np.bincount(picks[:, 0], minlength=8) / 6000 == pytest.approx(np.full(8, 1 / 8), abs=0.03) and np.bincount(picks.reshape(-1), minlength=8) / 6000 == pytest.approx(np.full(8, 3 / 8), abs=0.03)
    draw = np.random.default_rng(2)
    bins, y = draw.integers(0, 4, (3, 500)).astype(np.uint8), draw.integers(0, 2, 500).astype(float)
    y[bins[1] > 1] = 1.0
    sizes, root, all_of = np.array([4, 4, 4]), np.zeros(1, np.int64), np.array([[0, 1, 2]])
    sums = trees._tree_sums((bins.tobytes(), y.tobytes()), 0, 0, 7, 0, root[:0], np.zeros(0, np.uint8), root, all_of, sizes)
    best = trees._choose_gini(sums, all_of, sizes, np.array([1.0, 1.0]), 1)[0]
    w = trees._bootstrap(7, 0, 0, 500).astype(float)

    def gini(mask):
        p = w[mask & (y == 1)].sum() / w[mask].sum()
        return w[mask].sum() / w.sum() * 2 * p * (1 - p)
    everything = np.ones(500, bool)
    gains = {(f, b): gini(everything) - gini(bins[f] <= b) - gini(bins[f] > b) for f in range(3) for b in range(3)}
    at = max(gains, key=gains.get)
    assert (best[0], best[1]) == at == (1, 1) and best[2] == pytest.approx(gains[at])
    assert best[3:5].sum() == w[bins[1] <= 1].sum() and best[5] == 0


def test_scores_are_sparks(spark, table):
    """Sums over batches of rows against Spark's own transform, also of missing numbers, and only one pass through the trees in a plan."""
    n = table.count()
    boosted = trees.fit_boosted(table, n, GBTClassifier(maxIter=6, maxDepth=4, seed=3))
    forest = RandomForestClassifier(numTrees=9, maxDepth=7, seed=3).fit(table)
    odd = table.unionByName(spark.createDataFrame([(Vectors.dense([float("nan"), 1.0, 0, 0, 0, 0, 1, 0]), 0.0)], table.schema))
    for model in (boosted, forest):
        rows = model.transform(training.scored(odd, model)).select("_raw", "_p1", "rawPrediction", "probability").collect()
        assert [r._raw for r in rows] == pytest.approx([r.rawPrediction[1] for r in rows], abs=1e-12)
        assert [r._p1 for r in rows] == pytest.approx([r.probability[1] for r in rows], abs=1e-12)
        assert len(rows) == n + 1
    from churnlake.functions.scoring import with_risk
    plan = with_risk(training.scored(table, boosted), F.col("_p1")).drop("_raw", "_p1")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
