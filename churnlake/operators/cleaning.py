"""Canonical names, defaults, cleaning and binary encoding of customer tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import NumericType, StringType

from churnlake import config as c
from churnlake.operators.ordering import fitted_quantiles
from churnlake.session import staged

_SPACE = " \t\n\r\x0b\x0c"


def canonical_columns(df: DataFrame) -> DataFrame:
    """Rename snake_case columns unless the canonical name is there already."""
    return df.withColumnsRenamed(
        {old: new for old, new in c.CANONICAL_NAMES.items() if old in df.columns and new not in df.columns})


def with_defaults(df: DataFrame) -> DataFrame:
    """Add absent optional columns with their default."""
    return df.withColumns({x: F.lit(v) for x, v in c.COLUMN_DEFAULTS.items() if x not in df.columns})


def is_text(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, StringType)


def is_number(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, NumericType)


def number(col: Column) -> Column:
    """Numeric value, null when it does not parse; NaN never survives."""
    value = col.cast("string").try_cast("double")
    return F.when(~F.isnan(value), value)


def column_number(df: DataFrame, name: str) -> Column:
    """The same for a column of the frame; numeric columns skip the detour over text."""
    if not is_number(df, name):
        return number(F.col(name))
    value = F.col(name).cast("double")
    return F.when(~F.isnan(value), value)


def trim_text(df: DataFrame) -> DataFrame:
    return df.withColumns({f.name: F.btrim(f.name, F.lit(_SPACE)) for f in df.schema
                           if isinstance(f.dataType, StringType)})


def drop_exact_duplicates(df: DataFrame) -> DataFrame:
    """One row per distinct row, ID included; repeats meet in the map-side aggregate."""
    return df.dropDuplicates()


def duplicate_report(df: DataFrame) -> DataFrame:
    """Rows, distinct rows and dropped rows."""
    copies = df.groupBy(*df.columns).agg(F.count("*").alias("_copies"))
    rows, kept = F.coalesce(F.sum("_copies"), F.lit(0)), F.count("*")
    return copies.agg(rows.alias("rows"), kept.alias("kept"), (rows - kept).alias("dropped"))


def total_charges(df: DataFrame) -> Column:
    return column_number(df, "TotalCharges") if "TotalCharges" in df.columns else F.lit(0.0)


def encode_target(df: DataFrame, name: str = c.TARGET) -> Column:
    """1 for Yes / 1, else 0; numeric columns truncate to int."""
    if is_text(df, name):
        return F.coalesce(F.when(F.col(name).isin("Yes", "1"), 1), F.lit(0))
    return F.coalesce(F.col(name).try_cast("int"), F.lit(0))


def clean_customers(df: DataFrame, drop_duplicates: bool = True, charges_median: float | None = None) -> DataFrame:
    """Trim, de-duplicate, coerce numbers, fill TotalCharges with the median, encode the target.

    The median is the exact one of this frame unless a fitted value is passed. Scoring passes one and
    keeps duplicates. Without one the rows are read twice, so the de-duplicated rows are written first:
    the whole-row shuffle runs once, and the median scans one column.
    """
    df = trim_text(df)
    if drop_duplicates:
        df = drop_exact_duplicates(df)
        if charges_median is None:
            df = staged(df, "distinct")
    df = df.withColumn("TotalCharges", total_charges(df))
    if charges_median is None:
        charges_median = fitted_quantiles(df, ["TotalCharges"])["TotalCharges"]
    fixed = {"TotalCharges": F.coalesce("TotalCharges", F.lit(charges_median).cast("double"), F.lit(0.0))}
    for name in c.NUMERIC:
        if name in df.columns and name != "TotalCharges":
            fixed[name] = F.coalesce(column_number(df, name), F.lit(0.0))
    if "SeniorCitizen" in df.columns:
        fixed["SeniorCitizen"] = F.coalesce(column_number(df, "SeniorCitizen").try_cast("int"), F.lit(0))
    if c.TARGET in df.columns:
        fixed[c.TARGET] = encode_target(df)
    return df.withColumns(fixed)


def binary_encode(df: DataFrame) -> DataFrame:
    """Yes/No and gender columns to 1/0; numeric columns stay."""
    def flag(name: str) -> Column:
        hit = F.lower(name) == "female" if name == "gender" else F.col(name) == "Yes"
        return F.coalesce(hit.cast("int"), F.lit(0))
    return df.withColumns({x: flag(x) for x in c.BINARY if x in df.columns and not is_number(df, x)})
