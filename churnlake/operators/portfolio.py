"""Revenue at risk of a portfolio, as a whole and by segment."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from churnlake import config as c
from churnlake.functions.revenue import lifetime_value, savings_total
from churnlake.functions.rounding import exact_avg, exact_sum, half_even


def _need(df: DataFrame, *columns: str) -> None:
    missing = [x for x in columns if x not in df.columns]
    if missing:
        raise ValueError(f"columns needed: {missing}")


def with_savings(df: DataFrame) -> DataFrame:
    """Monthly savings over each row's recommendations."""
    return df.withColumn("estimated_savings", savings_total(F.col("recommendations")))


def portfolio_risk(df: DataFrame) -> DataFrame:
    """One row of counts, losses, recoverable revenue and lifetime value at risk."""
    _need(df, "churn_probability", "MonthlyCharges")
    p, charges = F.col("churn_probability"), F.col("MonthlyCharges")
    high = p >= c.HIGH_RISK
    sums = df.agg(
        F.count("*").alias("total_customers"),
        F.count_if(high).alias("high_risk_count"),
        F.count_if((p >= c.MEDIUM_RISK) & ~high).alias("medium_risk_count"),
        F.count_if(p < c.MEDIUM_RISK).alias("low_risk_count"),
        exact_sum(charges).alias("revenue"),
        exact_sum(charges * p).alias("loss"),
        F.coalesce(exact_sum(F.when(high, charges)), F.lit(0.0)).alias("worst"),
        exact_sum(lifetime_value(charges) * p).alias("ltv"),
        exact_avg(p).alias("mean_p"),
        *([F.coalesce(exact_sum(F.col("estimated_savings")), F.lit(0.0)).alias("savings")]
          if "estimated_savings" in df.columns else []))
    annual = F.col("loss") * 12
    recoverable = F.col("savings") * 12 if "estimated_savings" in df.columns else annual * c.RECOVERY_SHARE
    return sums.select(
        "total_customers", "high_risk_count", "medium_risk_count", "low_risk_count",
        half_even(F.col("revenue")).alias("total_monthly_revenue"),
        half_even(F.col("loss")).alias("expected_monthly_loss"),
        half_even(annual).alias("expected_annual_loss"),
        half_even(F.col("worst") * 12).alias("worst_case_annual_loss"),
        half_even(recoverable).alias("recoverable_revenue_annual"),
        half_even(F.greatest(F.lit(0.0), annual - recoverable)).alias("net_revenue_at_risk_annual"),
        half_even(F.col("mean_p"), 4).alias("avg_churn_probability"),
        half_even(F.col("ltv")).alias("total_ltv_at_risk"))


def risk_by_segment(df: DataFrame) -> DataFrame:
    """Expected annual loss and mean probability per segment."""
    _need(df, "segment", "churn_probability", "MonthlyCharges")
    p, charges = F.col("churn_probability"), F.col("MonthlyCharges")
    return df.groupBy("segment").agg(
        half_even(exact_sum(charges * p) * 12).alias("expected_annual_loss"),
        half_even(exact_avg(p), 4).alias("avg_churn_probability"))


def portfolio_stats(df: DataFrame) -> DataFrame:
    """Size, bands, rates and losses of a scored table; zero rows in, zero counts out."""
    p = F.col("churn_probability")
    aggregates = [
        F.count("*").alias("total_customers"), F.count_if(p >= c.HIGH_RISK).alias("high_risk"),
        F.count_if((p >= c.MEDIUM_RISK) & (p < c.HIGH_RISK)).alias("medium_risk"),
        F.count_if(p < c.MEDIUM_RISK).alias("low_risk"), exact_avg(p).alias("mean_p"),
    ]
    rate = F.col("mean_p")
    if "churn_label" in df.columns:
        aggregates.append(F.count_if(F.col("churn_label") == "Churn").alias("churners"))
        rate = F.try_divide(F.col("churners").cast("double"), F.col("total_customers"))
    money = []
    if "MonthlyCharges" in df.columns:
        charges = F.col("MonthlyCharges")
        aggregates += [exact_sum(charges).alias("revenue"),
                       exact_sum(charges * p).alias("loss")]
        loss = half_even(F.col("loss"))
        money = [half_even(F.col("revenue")).alias("total_monthly_revenue"), loss.alias("expected_monthly_loss"),
                 half_even(loss * 12).alias("expected_annual_loss")]
    return df.agg(*aggregates).select(
        "total_customers", "high_risk", "medium_risk", "low_risk",
        half_even(F.col("mean_p"), 4).alias("avg_churn_probability"), half_even(rate, 4).alias("churn_rate"), *money)


def segment_distribution(df: DataFrame) -> DataFrame:
    return df.groupBy("segment").agg(F.count("*").alias("customers"))


def live_annual_loss(latest: DataFrame) -> DataFrame:
    """Annual loss over latest predictions joined with customers."""
    total = exact_sum(F.col("MonthlyCharges") * F.col("churn_probability")) * 12
    return latest.agg(F.coalesce(half_even(total), F.lit(0.0)).alias("expected_annual_revenue_loss"))
