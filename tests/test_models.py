"""Training, evaluation, explanation and segmentation."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from churnlake.functions.features import engineer_features
from churnlake.functions.scoring import with_scorecard
from churnlake.operators import evaluation, explain, model_scoring, segments, sketches, training
from churnlake.operators.ordering import exact_quantiles
from churnlake.plans import batch_run, customer_scoring
from churnlake.session import work_path
from churnlake.sources import adapters

SIZES = {"trees": 8, "rounds": 5, "forest_depth": 5, "boost_depth": 3}


@pytest.fixture(scope="module")
def run(spark):
    return training.train_customers(adapters.customers(spark, "/root/testdata/sf0.01"), **SIZES)


def test_models_beat_chance(run):
    rows = {r.model: r for r in run.metrics().collect()}
    assert set(rows) == set(training.MODELS) and all(r.roc_auc > 0.6 for r in rows.values())
    assert sum(r.best for r in rows.values()) == 1 and rows[run.best].roc_auc == max(r.roc_auc for r in rows.values())
    assert rows[run.best].feature_count == 32
    assert rows[run.best].train_size + rows[run.best].test_size == 1500
    gate = {r.check: r.passed for r in evaluation.quality_gate(run.metrics().where("best")).collect()}
    assert gate["train_share"] and gate["churn_rate_gap"] and gate["roc_auc"]


def test_scores_keep_every_row(spark, run, customers):
    doubled = customers.unionByName(customers)
    scored = training.score_batch(doubled, run.encoder, run.best_model)
    assert scored.count() == doubled.count()
    assert scored.columns == customers.columns + ["churn_probability", "churn_label", "risk_score", "risk_category"]
    bad = scored.where((F.col("churn_probability") < 0) | (F.col("churn_probability") > 1))
    assert bad.isEmpty()


def test_short_snake_case_record(spark, run):
    df = spark.createDataFrame([(3, 90.0, "Month-to-month", "Electronic check", 70), (60, 25.0, "Two year", "Mailed check", 1)],
                               "tenure int, monthly_charges double, contract string, payment_method string, inactive_days int")
    first, second = training.score_batch(df, run.encoder, run.models["logistic_regression"]).collect()
    assert first.churn_probability > second.churn_probability and first.monthly_charges == 90.0


def test_save_and_load(spark, run, customers):
    path = work_path(spark, "test-models")
    training.save_run(run, path)
    encoder, model, meta = training.load_model(spark, path)
    assert meta["best_model"] == run.best
    a = training.score_batch(customers, run.encoder, run.best_model).select("customerID", "churn_probability")
    b = training.score_batch(customers, encoder, model).select("customerID", "churn_probability")
    assert a.exceptAll(b).isEmpty()


def test_importance_shares(spark, run):
    rows = evaluation.feature_importance(spark, run.models["random_forest"], run.features, 40).collect()
    assert sum(r.importance for r in rows) == pytest.approx(1.0, abs=1e-4)
    assert [r.importance for r in rows] == sorted((r.importance for r in rows), reverse=True)


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.4), (0, 0.6), (0, 0.1), (0, 0.2)], "label int, churn_probability double")
    row = evaluation.evaluate(df).first()
    assert (row.accuracy, row.precision, row.recall, row.f1) == (0.6, 0.5, 0.5, 0.5)
    assert (row.support_0, row.support_1) == (3, 2)
    assert evaluation.roc_auc(df).first().roc_auc == pytest.approx(5 / 6, abs=1e-6)
    empty = evaluation.evaluate(df.withColumn("churn_probability", F.lit(0.0))).first()
    assert (empty.precision, empty.recall, empty.f1) == (0.0, 0.0, 0.0)
    matrix = {r.actual: (r.predicted_0, r.predicted_1) for r in evaluation.confusion_matrix(df).collect()}
    assert matrix == {0: (2, 1), 1: (1, 1)}


def test_explanations(spark):
    names, weights, means = ["a", "b", "c"], [2.0, -1.0, 0.5], [1.0, 1.0, 1.0]
    df = spark.createDataFrame([(1, Vectors.dense(3.0, 5.0, 1.0))], ["id", "features"])
    row = explain.explain_customers(explain.explain_rows(df, names, weights, means).withColumn(
        "churn_probability", F.lit(0.734))).first()
    assert [(e.feature, e.shap_value, e.impact) for e in row.explanation] == [
        ("a", 4.0, "positive"), ("b", -4.0, "negative"), ("c", 0.0, "negative")]
    assert row.explanation_text == ("This customer has a 73% probability of churning. The primary drivers are: a. "
                                    "Protective factors include: b, c.")
    top = explain.global_importance(df, names, weights, means, 2).collect()
    assert [(r.feature, r.importance, r.direction) for r in top] == [
        ("a", 4.0, "increases_churn"), ("b", 4.0, "decreases_churn")]
    assert df.select(explain.to_text(F.array().cast(explain.EXPLANATION_SCHEMA))).first()[0] is None


def test_centroid_names():
    assert segments.name_centroid({"churn_probability": 0.6, "InactiveDays": 45}) == "Inactive"
    assert segments.name_centroid({"churn_probability": 0.5, "tenure": 18}) == "Risky"
    assert segments.name_centroid({"MonthlyCharges": 70, "engagement_score": 40, "tenure": 30}) == "Premium"
    assert segments.name_centroid({}) == "Loyal"


def test_settled_names():
    assert segments.settle_names(["Loyal", "Risky", "Premium", "Inactive"], [0, 1, 2, 3]) == ["Loyal", "Risky", "Premium", "Inactive"]
    assert segments.settle_names(["Loyal", "Loyal", "Risky", "Loyal"], [0.1, 0.3, 0.9, 0.2]) == ["Premium", "Loyal", "Risky", "Risky"]
    assert segments.settle_names(["Risky"] * 4, [0.4, 0.3, 0.2, 0.1]) == ["Risky", "Loyal", "Premium", "Inactive"]


def test_segments_of_four_blocks(spark):
    blocks = [(60, 30.0, 2, 0.1, 1, 5.0), (40, 95.0, 5, 0.2, 7, 65.0), (3, 60.0, 10, 0.7, 2, 10.0), (30, 50.0, 80, 0.8, 1, 0.0)]
    df = spark.createDataFrame([b for b in blocks for _ in range(20)],
                               "tenure int, MonthlyCharges double, InactiveDays int, churn_probability double, "
                               "service_count int, engagement_score double")
    fitted = segments.fit_segments(df, starts=4)
    path = work_path(spark, "test-segments")
    fitted.save(spark, path)
    found = segments.Segmenter.load(spark, path).assign(df)
    counts = {r.segment: r["count"] for r in found.groupBy("segment").count().collect()}
    assert counts == {"Loyal": 20, "Premium": 20, "Risky": 20, "Inactive": 20}
    profile = {r.segment: r for r in segments.segment_profile(found).collect()}
    assert profile["Premium"].median_MonthlyCharges == 95.0 and profile["Risky"].pct_of_total == 25.0


def test_many_starts_in_one_pass(spark, customers):
    """Each start is what a fit of its own ends at, and the best of them is no worse than Spark's best."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler
    from churnlake.operators import kmeans
    matrix = customers.select(*[(F.col(x) / s).cast("double").alias(n) for n, x, s in
                                (("a", "tenure", 24.0), ("b", "MonthlyCharges", 30.0), ("c", "InactiveDays", 26.0))]).persist()
    fits = kmeans.all_starts(matrix, 4, 6, 300, 1)
    rows = np.array([tuple(r) for r in matrix.collect()])
    for fit in fits:
        centers = np.array(fit.centers)
        far = ((rows[:, None] - centers) ** 2).sum(axis=2)
        owner = far.argmin(axis=1)
        assert fit.cost == pytest.approx(far.min(axis=1).sum())
        assert all(np.allclose(rows[owner == j].mean(axis=0), centers[j], atol=1e-3) for j in range(4))     # at rest
    best = kmeans.best_clusters(matrix, 4, 6, 300, 1)
    assert best.cost == min(x.cost for x in fits)
    vectors = VectorAssembler(inputCols=matrix.columns, outputCol="features").transform(matrix)
    spark_best = min(KMeans(k=4, maxIter=300, seed=s).fit(vectors).summary.trainingCost for s in range(3))
    assert best.cost <= spark_best * 1.01
    got = [r[0] for r in matrix.select(best.nearest([F.col(x) for x in matrix.columns])).collect()]
    assert got == ((rows[:, None] - np.array(best.centers)) ** 2).sum(axis=2).argmin(axis=1).tolist()
    same = spark.createDataFrame([(1.0, 2.0)] * 9, "a double, b double")
    assert kmeans.best_clusters(same, 4, 2, 10, 0).cost == 0.0
    with pytest.raises(ValueError):
        kmeans.best_clusters(same.limit(0), 2, 1, 5, 0)


def test_quantile_sketches(spark):
    """The rank of a sketched quantile is within the stated error, for sketches of all rows and merged from parts."""
    rng = np.random.default_rng(3)
    values = {"g": rng.normal(size=60_000), "h": np.floor(rng.exponential(50, 60_000)), "small": np.arange(5.0)}
    rows = [(k, i % 7, float(x)) for k, v in values.items() for i, x in enumerate(v)] + [("none", 0, None), ("g", 0, None)]
    df = spark.createDataFrame(rows, "key string, day int, x double")
    whole = sketches.sketched_quantiles(df, ["x"], [0.01, 0.5, 0.99], ["key"])
    days = sketches.quantile_sketches(df, ["x"], ["key", "day"])
    merged = sketches.quantiles_of_sketches(sketches.merged_sketches(days, ["key"]), [0.01, 0.5, 0.99])
    bound = 2 * sketches.rank_error()
    for found in (whole, merged):
        got = {(r.key, r.probability): r.value for r in found.collect()}
        assert set(got) == {(k, p) for k in values for p in (0.01, 0.5, 0.99)}
        for (k, p), x in got.items():
            low, high = np.mean(values[k] < x), np.mean(values[k] <= x)
            assert low - bound <= p <= high + bound or k == "small"
    exact = {r.key: r.value for r in exact_quantiles(df, ["x"], [0.5], ["key"]).collect()}
    near = {r.key: r.value for r in whole.where("probability = 0.5").collect()}
    assert near["g"] == pytest.approx(exact["g"], abs=0.02) and near["small"] == exact["small"] == 2.0
    assert sketches.rank_error(200) == pytest.approx(0.0133, abs=1e-4)


def test_full_scoring(spark, run, customers):
    seg = segments.fit_segments(engineer_features(with_scorecard(customers)), starts=1)
    rows = customer_scoring.score_customers(customers, run.encoder, run.best_model, seg,
                                            explain.background_means(run.train)).collect()
    assert len(rows) == 150
    for r in rows:
        assert len(r.recommendations) <= 5 and len(r.explanation) == 10 and r.segment in ("Loyal", "Premium", "Risky", "Inactive")
        assert r.recommendations == [] or r.churn_probability >= 0.3 - 1e-9
        assert r.revenue_risk.expected_annual_loss == pytest.approx(12 * r.MonthlyCharges * r.churn_probability, abs=0.01)


def test_custom_model(spark, customers):
    table = customers.select("customerID", "tenure", "MonthlyCharges", "Contract", F.col("Churn").alias("left"))
    custom = training.train_custom(table, ["customerID"], hint="target", models=["logistic_regression"])
    assert custom.meta["target_column"] == "left" and custom.meta["n_samples"] == 150
    path = work_path(spark, "test-custom")
    training.save_custom(custom, spark, path)
    scored = model_scoring.score_custom(spark.createDataFrame([("x",)], "note string"), training.load_custom(spark, path)).first()
    assert scored.model_used.startswith("custom/") and scored.risk_score == round(scored.churn_probability * 100)
    assert scored.revenue_risk.expected_monthly_loss == pytest.approx(50 * scored.churn_probability, abs=0.01)


def test_responses(spark):
    rows = [(1, '```json\n{"churn_probability": 0.99}\n```', 10.0), (2, '{"churn_probability": "0.2", "segment": "Premium"}', 0.0),
            (3, "no json", None), (4, '{"explanation": "x"}', 20.0), (5, '{"churn_probability": "high"}', 20.0)]
    df = spark.createDataFrame(rows, "id int, response string, MonthlyCharges double")
    out = {r.id: r for r in model_scoring.normalise_responses(df, order=[F.col("id")]).collect()}
    assert (out[1].churn_probability, out[1].risk_score, out[1].segment, out[1].expected_monthly_loss) == (0.95, 95, "Risky", 9.5)
    assert (out[2].churn_probability, out[2].segment, out[2].expected_monthly_loss) == (0.2, "Premium", 10.0)
    assert (out[3].churn_label, out[3].segment, out[3].expected_annual_loss) == ("Unknown", "Unknown", 300.0)
    assert (out[4].churn_probability, out[4].churn_label, out[4].explanation) == (0.5, "Churn", "x")
    assert out[5].churn_label == "Unknown" and out[5].row_number == 5


def test_batch_run(spark, folder, customers):
    raw = customers.withColumns({f.name: F.col(f.name).cast("string") for f in customers.schema})
    result = batch_run.run_batch(raw, work_path(spark, "test-run"), ["logistic_regression"], 1)
    report = result.report.select(F.from_json("value", "best_model string, segment_profile array<struct<count: int>>, "
                                  "revenue_risk struct<total_customers: int>").alias("r")).first().r
    assert report.best_model == "logistic_regression" and report.revenue_risk.total_customers == 150
    assert sum(s["count"] for s in report.segment_profile) == 150


def test_one_pass_sends_a_row_per_task_and_cluster(spark):
    """Sums of a pass against numpy, and what its tasks send: no row is copied to the starts."""
    from churnlake.operators import kmeans
    rows = np.random.default_rng(3).normal(size=(5000, 3)).round(1)
    matrix = spark.createDataFrame([tuple(map(float, x)) for x in rows], "f0 double, f1 double, f2 double").repartition(2)
    centers = {s: [[float(v) for v in x] for x in rows[s:s + 4]] for s in (0, 7)}
    found = kmeans._Pass(matrix)(centers)
    for s, places in centers.items():
        far = np.array([[sum((r[i] - p[i]) ** 2 for i in range(3)) for p in places] for r in rows])
        nearest = far.argmin(axis=1)
        for j in range(4):
            n, cost, sums = found[s, j]
            mine = nearest == j
            assert n == mine.sum() and cost == pytest.approx(far[mine].min(axis=1).sum()) and sums == pytest.approx(rows[mine].sum(axis=0).tolist())
    sent = list(kmeans._nearest_sums(kmeans._packed(pa.Table.from_arrays([*rows.T], ["a", "b", "c"]).to_batches()), [0, 7], np.array([*centers.values()])))
    assert sum(x.num_rows for x in sent) == len(found)


def test_rows_spread_over_cores(spark):
    from churnlake.session import LEAST_ROWS, MOST_ROWS, spread
    one = spark.range(0, 3 * LEAST_ROWS, 1, 1)
    assert spread(one, 3 * LEAST_ROWS).rdd.getNumPartitions() == min(3, spark.sparkContext.defaultParallelism)
    assert spread(one, LEAST_ROWS).rdd.getNumPartitions() == 1
    assert spread(one, 40 * MOST_ROWS).rdd.getNumPartitions() >= 40
