"""Behavioural features as column expressions over the canonical customer columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from churnlake import config as c
from churnlake.functions.scoring import banded, lookup


def _count_yes(columns: list[str], present: list[str]) -> Column:
    flags = [F.coalesce((F.col(x) == "Yes").cast("int"), F.lit(0)) for x in columns if x in present]
    return sum(flags, F.lit(0))


def _any_yes(columns: list[str], present: list[str]) -> Column:
    return (_count_yes(columns, present) > 0).cast("int")


def _band(col: Column, edges: list[int]) -> Column:
    """Right-closed bins numbered from 0."""
    return banded(col, list(zip(edges, range(len(edges)))), len(edges), upper=True)


def charge_per_tenure() -> Column:
    return F.when(F.col("tenure") > 0, F.col("MonthlyCharges") / F.col("tenure")).otherwise(0.0)


def service_count(present: list[str] = c.SERVICES) -> Column:
    return _count_yes(c.SERVICES, present)


def engagement_score(present: list[str] = c.SERVICES) -> Column:
    raw = service_count(present) * 10 - F.col("InactiveDays") * 0.5
    return F.least(F.greatest(raw, F.lit(0.0)), F.lit(100.0))


def total_charge_ratio() -> Column:
    expected = F.col("tenure") * F.col("MonthlyCharges")
    paid = F.coalesce(F.col("TotalCharges").cast("string").try_cast("double"), F.lit(0.0))
    ratio = F.least(F.greatest(F.try_divide(paid, expected), F.lit(0.0)), F.lit(2.0))
    return F.when(expected > 0, ratio).otherwise(1.0)


def feature_columns(present: list[str]) -> dict[str, Column]:
    """All engineered features, given the columns the frame has."""
    return {
        "charge_per_tenure": charge_per_tenure(),
        "service_count": service_count(present),
        "is_high_value": (F.col("MonthlyCharges") > c.HIGH_VALUE_CHARGE).cast("int"),
        "contract_risk_score": lookup(F.col("Contract"), c.CONTRACT_RISK, 1),
        "payment_risk_score": lookup(F.col("PaymentMethod"), c.PAYMENT_RISK, 1),
        "engagement_score": engagement_score(present),
        "tenure_band": _band(F.col("tenure"), c.TENURE_BAND_EDGES),
        "charge_band": _band(F.col("MonthlyCharges"), c.CHARGE_BAND_EDGES),
        "total_charge_ratio": total_charge_ratio(),
        "has_streaming": _any_yes(["StreamingTV", "StreamingMovies"], present),
        "has_security": _any_yes(["OnlineSecurity", "TechSupport"], present),
    }


def engineer_features(df: DataFrame) -> DataFrame:
    """Append the eleven features in one projection."""
    return df.withColumns(feature_columns(df.columns))
