"""Churn alerts: rule and message, the same expressions on batch frames and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from churnlake import config as c
from churnlake.functions.rounding import half_even
from churnlake.operators.activity import moment


# Fixed text: the wording of the alert message.
def _message(customer: Column, p: Column, band: Column, inactive: Column, loss: Column) -> Column:
    percent = half_even(p * 100, 1).cast("decimal(5,1)").cast("string")
    return F.concat(
        F.lit("Customer #"), F.coalesce(customer.cast("string"), F.lit("N/A")), F.lit(" flagged with "), percent,
        F.lit("% churn probability. Risk: "), band, F.lit(". Inactive: "), inactive.cast("string"),
        F.lit(" days. Annual revenue at risk: $"), F.format_number(half_even(loss, 0), 0), F.lit("."))


def alerts(df: DataFrame) -> DataFrame:
    """Alert rows of scored predictions that carry customer columns.

    Needs prediction_id, customer_id, churn_probability, prediction_label, InactiveDays, MonthlyCharges,
    created_at; uses top_action where present.
    """
    p, inactive = F.col("churn_probability"), F.coalesce("InactiveDays", F.lit(0))
    loss = half_even(p * F.coalesce("MonthlyCharges", F.lit(0.0)) * 12)
    high = p >= c.ALERT_HIGH
    action = F.lit(c.NO_ALERT_ACTION)
    if "top_action" in df.columns:
        action = F.coalesce(F.nullif(F.col("top_action"), F.lit(c.NO_ACTION)), action)
    return df.where(high | ((p >= c.ALERT_MEDIUM) & (inactive >= c.ALERT_INACTIVE_DAYS))).select(
        "prediction_id", "customer_id",
        F.when(high, "high_risk").otherwise("medium_risk").alias("alert_type"),
        F.col("prediction_label").alias("risk_category"),
        half_even(p, 4).alias("churn_probability"),
        _message(F.col("customer_id"), p, F.col("prediction_label"), inactive, loss).alias("message"),
        action.alias("top_action"), "created_at")


def recent_alerts(table: DataFrame, limit: int = 50, risk: str | None = None) -> DataFrame:
    """Newest alerts, one band if given."""
    if risk is not None:
        table = table.where(F.col("risk_category") == risk)
    return table.orderBy(F.desc("created_at"), F.desc("prediction_id")).limit(limit)


def alert_stats(table: DataFrame, as_of=None) -> DataFrame:
    """Totals, today's alerts, High alerts, e-mails sent, newest timestamp."""
    now = moment(as_of, table)
    return table.agg(
        F.count("*").alias("total_alerts"),
        F.count_if(F.to_date("created_at") == F.to_date(now)).alias("alerts_today"),
        F.count_if(F.col("risk_category") == "High").alias("high_risk_alerts"),
        F.count_if("email_sent").alias("emails_sent"), F.max("created_at").alias("last_alert_at"))
