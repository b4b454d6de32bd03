"""Quantile sketches: one mergeable summary for each group and metric, for those who choose it over the exact quantiles.

A sketch holds a few kilobytes whatever the number of rows, is stored as a binary column, and sketches of parts (days, shards, segments) are merged
without reading a row again. The value it gives for probability p has a true rank within ``rank_error(k)`` of p with 99 % confidence. Whether
sketches are used is an argument of the caller and never depends on the size of a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

DEFAULT_K = 800


def rank_error(k: int = DEFAULT_K) -> float:
    """Published single-sided error of a KLL sketch at 99 % confidence."""
    return 2.296 / k ** 0.9723


def quantile_sketches(df: DataFrame, metrics: list[str], keys: list[str] = (), k: int = DEFAULT_K) -> DataFrame:
    """Rows (keys, metric, sketch), one aggregate over the table; nulls count in no sketch, a metric without values has none."""
    wide = df.groupBy(*keys).agg(*[F.kll_sketch_agg_double(F.col(f"`{x}`").cast("double"), k).alias(f"s{i}") for i, x in enumerate(metrics)])
    cells = F.array(*[F.struct(F.lit(x).alias("metric"), F.col(f"s{i}").alias("sketch")) for i, x in enumerate(metrics)])
    return wide.select(*keys, F.inline(cells)).where(F.kll_sketch_get_n_double("sketch") > 0)


def merged_sketches(sketches: DataFrame, keys: list[str] = (), k: int = DEFAULT_K) -> DataFrame:
    """The sketches rolled up to fewer keys."""
    return sketches.groupBy(*keys, "metric").agg(F.kll_merge_agg_double("sketch", k).alias("sketch"))


def quantiles_of_sketches(sketches: DataFrame, probabilities: list[float]) -> DataFrame:
    """Rows (keys, metric, probability, value), the form of the exact quantiles."""
    keys = [x for x in sketches.columns if x not in ("metric", "sketch")]
    values = F.array(*[F.struct(F.lit(float(p)).alias("probability"), F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias("value"))
                       for p in probabilities])
    return sketches.select(*keys, "metric", F.inline(values))


def sketched_quantiles(df: DataFrame, metrics: list[str], probabilities: list[float], keys: list[str] = (), k: int = DEFAULT_K) -> DataFrame:
    """The sketched counterpart of ``ordering.exact_quantiles``."""
    return quantiles_of_sketches(quantile_sketches(df, metrics, keys, k), probabilities)
