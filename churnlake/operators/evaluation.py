"""Classifier metrics from conditional counts: nothing but grouped rows ever reaches a window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from churnlake import config as c
from churnlake.functions.rounding import half_even


def _ratio(top: Column, bottom: Column) -> Column:
    """Quotient, 0 when the denominator is 0."""
    return F.coalesce(F.try_divide(top.cast("double"), bottom), F.lit(0.0))


def confusion_counts(df: DataFrame, label: str = "label", p: str = "churn_probability",
                     threshold: float = c.CHURN_THRESHOLD, by: list[str] = ()) -> DataFrame:
    """tp, fp, tn, fn per group."""
    hit, real = F.col(p) >= threshold, F.col(label) == 1
    return df.groupBy(*by).agg(
        F.count_if(hit & real).alias("tp"), F.count_if(hit & ~real).alias("fp"),
        F.count_if(~hit & ~real).alias("tn"), F.count_if(~hit & real).alias("fn"))


def confusion_matrix(df: DataFrame, label: str = "label", p: str = "churn_probability",
                     threshold: float = c.CHURN_THRESHOLD) -> DataFrame:
    """Rows by true class with a column per predicted class."""
    hit = F.col(p) >= threshold
    return df.groupBy(F.col(label).alias("actual")).agg(
        F.count_if(~hit).alias("predicted_0"), F.count_if(hit).alias("predicted_1"))


def evaluate(df: DataFrame, label: str = "label", p: str = "churn_probability", by: list[str] = (),
             threshold: float = c.CHURN_THRESHOLD) -> DataFrame:
    """Accuracy, precision, recall, F1 and class supports per group."""
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    return confusion_counts(df, label, p, threshold, by).select(
        *by,
        half_even(_ratio(tp + tn, tp + fp + tn + fn), 4).alias("accuracy"),
        half_even(_ratio(tp, tp + fp), 4).alias("precision"),
        half_even(_ratio(tp, tp + fn), 4).alias("recall"),
        half_even(_ratio(tp * 2, tp * 2 + fp + fn), 4).alias("f1"),
        F.lit(threshold).alias("threshold"),
        (tn + fp).alias("support_0"), (tp + fn).alias("support_1"))


def class_report(df: DataFrame, label: str = "label", p: str = "churn_probability", by: list[str] = (),
                 threshold: float = c.CHURN_THRESHOLD) -> DataFrame:
    """Precision, recall, F1 and support per class, with macro and support-weighted rows."""
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))

    def line(name, hits, wrong, missed):
        return F.struct(F.lit(name).alias("class"), _ratio(hits, hits + wrong).alias("precision"),
                        _ratio(hits, hits + missed).alias("recall"),
                        _ratio(hits * 2, hits * 2 + wrong + missed).alias("f1"), (hits + missed).alias("support"))

    lines = confusion_counts(df, label, p, threshold, by).select(
        *by, line("0", tn, fn, fp).alias("zero"), line("1", tp, fp, fn).alias("one"))
    zero, one = F.col("zero"), F.col("one")
    total = zero["support"] + one["support"]

    def mean(name, weigh):
        def of(metric):
            if weigh:
                return _ratio(zero[metric] * zero["support"] + one[metric] * one["support"], total)
            return (zero[metric] + one[metric]) / 2
        return F.struct(F.lit(name).alias("class"), *[of(m).alias(m) for m in ("precision", "recall", "f1")],
                        total.alias("support"))

    rows = F.explode(F.array("zero", "one", mean("macro avg", False), mean("weighted avg", True)))
    return lines.select(*by, rows.alias("r")).select(
        *by, "r.class", *[half_even(F.col(f"r.{m}"), 4).alias(m) for m in ("precision", "recall", "f1")], "r.support")


def roc_points(df: DataFrame, label: str = "label", p: str = "churn_probability", by: list[str] = ()) -> DataFrame:
    """One point per 4-place score, high to low: at most 10,001 rows per group enter the window."""
    by = list(by)
    counts = df.groupBy(*by, half_even(F.col(p), 4).alias("threshold")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
    everything = Window.partitionBy(*by)
    down = everything.orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    return counts.select(
        *by, "threshold", "pos", "neg",
        _ratio(F.sum("neg").over(down), F.sum("neg").over(everything)).alias("fpr"),
        _ratio(F.sum("pos").over(down), F.sum("pos").over(everything)).alias("tpr"))


def roc_auc(df: DataFrame, label: str = "label", p: str = "churn_probability", by: list[str] = ()) -> DataFrame:
    """Area under the curve by trapezoids over tied scores."""
    by = list(by)
    order = Window.partitionBy(*by).orderBy(F.desc("threshold"))
    before = {x: F.lag(x, 1, 0.0).over(order) for x in ("fpr", "tpr")}
    area = (F.col("fpr") - before["fpr"]) * (F.col("tpr") + before["tpr"]) / 2
    return roc_points(df, label, p, by).withColumn("area", area).groupBy(*by).agg(
        half_even(F.sum("area"), 6).alias("roc_auc"))


def model_weights(model) -> list[float]:
    """Absolute coefficients or impurity importances, one number per feature."""
    if hasattr(model, "coefficients"):
        return [abs(float(x)) for x in model.coefficients]
    return [float(x) for x in model.featureImportances.toArray()]


def feature_importance(spark: SparkSession, model, names: list[str], top_n: int = 20) -> DataFrame:
    """Share of each feature in the model's total weight, largest first."""
    weights = model_weights(model)
    total = sum(weights) or 1.0
    shares = spark.createDataFrame([(n, w / total) for n, w in zip(names, weights)], "feature string, importance double")
    return (shares.orderBy(F.desc("importance"), "feature").limit(top_n)
            .withColumn("importance", half_even(F.col("importance"), 6)))


def quality_gate(metrics: DataFrame) -> DataFrame:
    """Checks on one row of accuracy, roc_auc, recall, f1, train/test size and churn rate."""
    g = c.QUALITY_GATE
    share = F.col("train_size") / (F.col("train_size") + F.col("test_size"))
    gap = F.abs(F.col("churn_rate_train") - F.col("churn_rate_test"))
    checks = [
        ("accuracy", F.col("accuracy"), F.col("accuracy") > g["min_accuracy"]),
        ("roc_auc", F.col("roc_auc"), (F.col("roc_auc") > g["min_auc"]) & (F.col("roc_auc") < g["max_auc"])),
        ("recall", F.col("recall"), F.col("recall") > g["min_recall"]),
        ("f1", F.col("f1"), F.col("f1") > g["min_f1"]),
        ("train_share", share, (share > g["min_train_share"]) & (share < g["max_train_share"])),
        ("churn_rate_gap", gap, gap < g["max_churn_gap"]),
    ]
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("check"), v.cast("double").alias("value"), ok.alias("passed"))
                               for n, v, ok in checks]))
    return metrics.select(rows.alias("r")).select("r.*")
