"""Executive summary: live operational numbers over the scored portfolio."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from churnlake.operators import activity, portfolio


def executive_summary(customers: DataFrame, predictions: DataFrame, calls: DataFrame, scored: DataFrame,
                      as_of=None) -> DataFrame:
    """One row; where both sides name a value, the live one wins."""
    latest = activity.latest_customers(predictions, customers)
    band = F.col("prediction_label")
    bands = activity.latest_per_customer(predictions, ["prediction_label"]).agg(
        F.count_if(band == "High").alias("high_risk"), F.count_if(band == "Medium").alias("medium_risk"),
        F.count_if(band == "Low").alias("low_risk"))
    return activity.combine_rows({
        "batch": portfolio.portfolio_stats(scored),
        "totals": activity.table_totals(customers, predictions, calls, as_of),
        "bands": bands,
        "loss": portfolio.live_annual_loss(latest),
    })


def executive_report(customers: DataFrame, predictions: DataFrame, calls: DataFrame, scored: DataFrame,
                     as_of=None) -> DataFrame:
    """The summary row with the 7-day trend and the top customers nested (7 and 10 entries)."""
    trend = activity.short_trend(predictions, as_of)
    top = activity.top_churn_customers(activity.latest_customers(predictions, customers))
    return activity.combine_rows({
        "summary": executive_summary(customers, predictions, calls, scored, as_of),
        "trend": trend.agg(F.sort_array(F.collect_list(F.struct("*"))).alias("prediction_trend")),
        "top": top.agg(F.sort_array(F.collect_list(F.struct("churn_probability", *[
            x for x in top.columns if x != "churn_probability"])), asc=False).alias("top_churn_customers")),
    })
