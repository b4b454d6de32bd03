"""Arrays to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def unfold(df: DataFrame, array: Column, keep: list, item: str = "item", place: str | None = None) -> DataFrame:
    """One row per element, empty arrays dropped; ``place`` numbers the elements from 1.

    The outer form plus a filter evaluates the array once. A plain explode makes the optimizer push a
    second copy of the array expression below as a size check.
    """
    if place is None:
        return df.select(*keep, F.explode_outer(array).alias(item)).where(F.col(item).isNotNull())
    rows = df.select(*keep, F.posexplode_outer(array).alias(place, item)).where(F.col(item).isNotNull())
    return rows.withColumn(place, F.col(place) + 1)
