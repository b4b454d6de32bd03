"""Derived operational tables: scored customers, recommendations and alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from churnlake import config as c
from churnlake.functions.arrays import unfold
from churnlake.functions.scoring import rule_segment, with_scorecard
from churnlake.operators import activity, alerts, recommend
from churnlake.sources import adapters


def scored_customers(spark: SparkSession, folder: str) -> DataFrame:
    """Customers with scorecard scores and rule segments."""
    return with_scorecard(adapters.customers(spark, folder)).withColumn("segment", rule_segment())


def recommended_customers(spark: SparkSession, folder: str) -> DataFrame:
    return recommend.recommend(scored_customers(spark, folder))


def recommendation_table(spark: SparkSession, folder: str) -> DataFrame:
    """Recommendations of every customer at the latest prediction, stamped with its time."""
    latest = activity.latest_per_customer(adapters.predictions(spark, folder), ["churn_probability"]).select(
        F.col("customer_id").alias(c.ID), "churn_probability", "created_at")
    scored = adapters.customers(spark, folder).join(latest, c.ID).withColumn("segment", rule_segment())
    rows = unfold(recommend.recommend(scored), F.col("recommendations"),
                  [F.col(c.ID).alias("customer_id"), "created_at"], "r")
    return rows.select(
        "customer_id", "r.rule_name", F.col("r.action").alias("recommended_action"), "r.estimated_savings",
        "r.priority", ((F.col("customer_id") + F.col("r.priority")) % 3 == 0).alias("is_completed"), "created_at")


def alert_inputs(spark: SparkSession, folder: str) -> DataFrame:
    return activity.with_customers(adapters.predictions(spark, folder), adapters.customers(spark, folder),
                                   ["MonthlyCharges", "InactiveDays"], "left")


def alert_table(spark: SparkSession, folder: str) -> DataFrame:
    return alerts.alerts(alert_inputs(spark, folder)).withColumn("email_sent", F.col("prediction_id") % 10 < 7)
