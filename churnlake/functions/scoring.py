"""Risk score, category, label and the additive scorecard as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from churnlake import config as c
from churnlake.functions.rounding import half_even


def lookup(col: Column, table: dict, default) -> Column:
    """Value of ``col`` in a small constant table."""
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.coalesce(F.create_map(*pairs)[col], F.lit(default))


def banded(col: Column, bands: list[tuple], below, *, upper: bool = False) -> Column:
    """Points of the first band that holds ``col``: by upper edge (<=) or by lower edge (>=).
    Null has no band and no points."""
    first = F.when(col.isNull(), F.lit(None))
    return reduce(
        lambda acc, band: acc.when(col <= band[0] if upper else col >= band[0], band[1]), bands, first
    ).otherwise(below)


def risk_score(p: Column) -> Column:
    """0-100 score: a logistic stretch of the probability around one half."""
    stretched = F.lit(100.0) / (1 + F.exp((p - 0.5) * -10))
    return half_even(stretched, 0).cast("int")


def risk_category(p: Column) -> Column:
    return F.when(p >= c.HIGH_RISK, "High").when(p >= c.MEDIUM_RISK, "Medium").when(p.isNotNull(), "Low")


def churn_label(p: Column, threshold: float = c.CHURN_THRESHOLD) -> Column:
    return F.when(p >= threshold, "Churn").when(p.isNotNull(), "No Churn")


def scorecard(tenure="tenure", charges="MonthlyCharges", inactive="InactiveDays",
              contract="Contract", payment="PaymentMethod") -> Column:
    """Churn probability of the additive scorecard; whole hundredths until the last division."""
    points = (
        F.lit(c.SCORECARD_BASE)
        + banded(F.col(tenure), c.SCORECARD_TENURE, c.SCORECARD_TENURE_ABOVE, upper=True)
        + banded(F.col(charges), c.SCORECARD_CHARGES, 0)
        + banded(F.col(inactive), c.SCORECARD_INACTIVE, c.SCORECARD_ACTIVE)
        + lookup(F.col(contract), c.SCORECARD_CONTRACT, 0)
        + lookup(F.col(payment), c.SCORECARD_PAYMENT, 0)
    )
    return F.greatest(F.lit(c.SCORECARD_FLOOR), F.least(F.lit(c.SCORECARD_CEILING), points)) / 100.0


def with_risk(df: DataFrame, probability: Column, threshold: float = c.CHURN_THRESHOLD) -> DataFrame:
    """Append churn_probability (4 places) and the columns derived from the unrounded value."""
    return df.withColumns({
        "churn_probability": half_even(probability, 4),
        "churn_label": churn_label(probability, threshold),
        "risk_score": risk_score(probability),
        "risk_category": risk_category(probability),
    })


def with_scorecard(df: DataFrame) -> DataFrame:
    return with_risk(df, scorecard())


def rule_segment(p="churn_probability", tenure="tenure", charges="MonthlyCharges",
                 inactive="InactiveDays") -> Column:
    """Segment by fixed cuts, first match wins."""
    return (
        F.when((F.col(p) >= 0.65) & (F.col(inactive) > 30), "Inactive")
        .when((F.col(p) >= 0.50) & (F.col(tenure) <= 18), "Risky")
        .when((F.col(charges) >= 70) & (F.col(p) < 0.50), "Premium")
        .otherwise("Loyal")
    )
