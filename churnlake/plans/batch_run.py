"""The batch job: clean, train, score, segment, advise, price, write."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from churnlake import config as c
from churnlake.functions.features import engineer_features
from churnlake.operators import explain, portfolio, recommend, segments, training
from churnlake.operators.activity import combine_rows
from churnlake.operators.cleaning import canonical_columns, clean_customers, with_defaults
from churnlake.session import intermediate_tables
from churnlake.sources import files


@dataclass
class BatchResult:
    """Where the outputs are, and the one-row report."""

    path: str
    best_model: str
    report: DataFrame


def _nested(df: DataFrame, name: str) -> DataFrame:
    """A frame of a few rows (models, segments) as one array."""
    return df.agg(F.sort_array(F.collect_list(F.struct("*"))).alias(name))


def run_batch(raw: DataFrame, path: str, models: list[str] | None = None, starts: int = c.KMEANS_STARTS,
              **sizes) -> BatchResult:
    """Run every stage over a raw customer table and write cleaned, models, scored and report below ``path``.

    Each stage reads the table the one before it wrote, so a lost executor never replays the whole job. Tables staged in between
    are gone when it ends.
    """
    with intermediate_tables(raw.sparkSession):
        return _run(raw, path, models, starts, **sizes)


def _run(raw: DataFrame, path: str, models: list[str] | None, starts: int, **sizes) -> BatchResult:
    spark: SparkSession = raw.sparkSession
    files.write_cleaned(clean_customers(with_defaults(canonical_columns(raw))), f"{path}/cleaned")
    cleaned = spark.read.parquet(f"{path}/cleaned")

    run = training.train_customers(cleaned, models, **sizes)
    training.save_run(run, f"{path}/models")
    means = explain.background_means(run.train)
    encoder, model, meta = training.load_model(spark, f"{path}/models")

    scored = training.score_batch(engineer_features(cleaned), encoder, model)
    files.write_cleaned(scored, f"{path}/predicted")
    predicted = spark.read.parquet(f"{path}/predicted")
    segmenter = segments.fit_segments(predicted, starts=starts)
    segmenter.save(spark, f"{path}/segmenter")
    advised = portfolio.with_savings(recommend.recommend(segmenter.assign(predicted)))
    files.write_scored(advised, f"{path}/scored")
    final = spark.read.parquet(f"{path}/scored")

    report = combine_rows({
        "best": spark.range(1).select(F.lit(meta["best_model"]).alias("best_model")),
        "training": _nested(run.metrics(), "training"),
        "profile": _nested(segments.segment_profile(final), "segment_profile"),
        "by_segment": _nested(portfolio.risk_by_segment(final), "risk_by_segment"),
        "risk": portfolio.portfolio_risk(final).select(F.struct("*").alias("revenue_risk")),
        "drivers": _nested(_importance(run, means), "feature_importance"),
    })
    files.write_report(report, f"{path}/report")
    run.release()
    return BatchResult(path, meta["best_model"], spark.read.text(f"{path}/report"))


def _importance(run: training.TrainingRun, means: list[float]) -> DataFrame:
    """Global importance of the best model: contributions if linear, else its own importances."""
    from churnlake.operators.evaluation import feature_importance
    if hasattr(run.best_model, "coefficients"):
        return explain.global_importance(run.test, run.features, [float(x) for x in run.best_model.coefficients], means)
    spark = run.test.sparkSession
    return explain.global_importance_fallback(feature_importance(spark, run.best_model, run.features, 15))
