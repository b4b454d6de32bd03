"""Row numbers, paging and exact quantiles that never sort the data in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from churnlake import config as c
from churnlake.session import cut_lineage

_POSITION_BITS = 33            # monotonically_increasing_id: partition in the bits above, row below


def _sorted_slices(df: DataFrame, order: list[Column]) -> DataFrame:
    """Globally sorted rows with ``_slice`` and ``_pos``, frozen so every later use sees the same slices."""
    mark = F.monotonically_increasing_id()
    frozen = cut_lineage(df.orderBy(*order).withColumn("_mark", mark))
    return frozen.withColumns({
        "_slice": F.shiftright("_mark", _POSITION_BITS),
        "_pos": F.col("_mark").bitwiseAND((1 << _POSITION_BITS) - 1),
    }).drop("_mark")


def with_row_number(df: DataFrame, order: list[Column], name: str = "row_number", start: int = 1) -> DataFrame:
    """Dense numbers in a total order: a range-partitioned sort plus one offset per slice."""
    slices = _sorted_slices(df, order)
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slices.groupBy("_slice").agg(F.count("*").alias("_n")).select(   # a row per sort partition
        "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return (
        slices.join(F.broadcast(offsets), "_slice")
        .withColumn(name, F.col("_before") + F.col("_pos") + start)
        .drop("_slice", "_pos", "_before")
    )


def clamp_page(page: int, size: int) -> tuple[int, int]:
    return max(1, int(page)), min(c.MAX_PAGE_SIZE, max(1, int(size)))


def page_rows(df: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    """One page of a totally ordered frame, in order: row numbers over a range-partitioned sort, whatever the page."""
    page, size = clamp_page(page, size)
    skip = (page - 1) * size
    numbered = with_row_number(df, order, "_row").where(F.col("_row").between(skip + 1, skip + size))
    return numbered.orderBy("_row").drop("_row")


def page_info(df: DataFrame, page: int, size: int) -> DataFrame:
    """Total, page count and neighbours as one row."""
    page, size = clamp_page(page, size)
    pages = F.greatest(F.lit(1), F.ceil(F.col("total") / size)).cast("bigint")
    return df.agg(F.count("*").alias("total")).select(
        "total", F.lit(page).alias("page"), F.lit(size).alias("page_size"), pages.alias("pages"),
        (F.lit(page) < pages).alias("has_next"), F.lit(page > 1).alias("has_prev"))


def value_counts(df: DataFrame, numeric: list[str], nominal: list[str] = (), keys: list[str] = ()) -> DataFrame:
    """Rows (keys, metric, value, word, n): every column's distinct values with their counts, one scan.

    Repeats meet in the map-side aggregate. Numbers are in ``value``, words in ``word``; nulls count too.
    The result is frozen, so that all statistics come from the same scan.
    """
    cells = [F.struct(F.lit(x).alias("metric"), F.col(x).cast("double").alias("value"),
                      F.lit(None).cast("string").alias("word")) for x in numeric]
    cells += [F.struct(F.lit(x).alias("metric"), F.lit(None).cast("double").alias("value"),
                       F.col(x).cast("string").alias("word")) for x in nominal]
    long = df.select(*keys, F.explode(F.array(*cells)).alias("cell")).select(*keys, "cell.*")
    return cut_lineage(long.groupBy(*keys, "metric", "value", "word").agg(F.count("*").alias("n")))


def _running_counts(counts: DataFrame, group: list[str]) -> DataFrame:
    """Append ``through`` (rows up to and including the value) and ``total`` of the group.

    The values are sorted by range; sums per slice give each slice its offset, and windows stay inside a slice.
    """
    per_group = Window.partitionBy(*group)
    slices = _sorted_slices(counts, [F.col(x) for x in [*group, "value"]])
    earlier = per_group.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slices.groupBy(*group, "_slice").agg(F.sum("n").alias("_n")).select(   # at most groups + slices rows
        *group, "_slice", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_n").over(per_group).alias("total"))
    inside = Window.partitionBy(*group, "_slice").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    return slices.join(offsets, [*group, "_slice"]).withColumn("through", F.col("_before") + F.sum("n").over(inside))


def quantiles_of_counts(counts: DataFrame, probabilities: list[float], keys: list[str] = ()) -> DataFrame:
    """Interpolated quantiles of a value-count table: rows (keys, metric, probability, value)."""
    group = [*keys, "metric"]
    running = _running_counts(counts.where(F.col("value").isNotNull()).select(*group, "value", "n"), group)
    position = (F.col("total") - 1) * F.col("probability")
    near = (
        running.withColumn("probability", F.explode(F.array(*[F.lit(float(p)) for p in probabilities])))
        .withColumns({"low": F.floor(position), "high": F.ceil(position), "share": position - F.floor(position)})
        .where((F.col("through") > F.col("low")) & (F.col("through") - F.col("n") <= F.col("high")))
    )
    low = F.min("value")
    high = F.min(F.when(F.col("through") > F.col("high"), F.col("value")))
    return near.groupBy(*group, "probability").agg((low + (high - low) * F.first("share")).alias("value"))


def exact_quantiles(df: DataFrame, metrics: list[str], probabilities: list[float], keys: list[str] = ()) -> DataFrame:
    """Exact interpolated quantiles per key and metric."""
    return quantiles_of_counts(value_counts(df, metrics, keys=list(keys)), probabilities, list(keys))


def fitted_quantiles(df: DataFrame, metrics: list[str], probability: float = 0.5) -> dict[str, float]:
    """One quantile per column on the driver: as many numbers as columns."""
    return collect_quantiles(value_counts(df, metrics), metrics, probability)


def collect_quantiles(counts: DataFrame, metrics: list[str], probability: float = 0.5) -> dict[str, float]:
    rows = quantiles_of_counts(counts, [probability]).select("metric", "value").collect()
    found = {r["metric"]: r["value"] for r in rows}
    return {m: found.get(m) for m in metrics}
