"""Operational questions over predictions, customers and user history."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from churnlake import config as c
from churnlake.functions.rounding import exact_avg, half_even

TREND_DAYS = 7
TOP_CUSTOMERS = 10


def moment(as_of: datetime | Column | None, table: DataFrame, column: str = "created_at") -> Column:
    """The reference moment: as given, else the newest timestamp of the table (a scalar subquery)."""
    if as_of is None:
        return table.agg(F.max(column)).scalar()
    return as_of if isinstance(as_of, Column) else F.lit(as_of)


def latest_per_customer(predictions: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Exactly one row per customer (null is a customer too): newest, then highest id.

    A max over a struct combines on the map side, so a customer with very many rows costs one row per task.
    ``columns`` keeps the struct, and with it the scan and the shuffle, to what is used.
    """
    rest = [x for x in columns or predictions.columns if x not in ("customer_id", "created_at", "prediction_id")]
    newest = F.max(F.struct("created_at", "prediction_id", *rest)).alias("_newest")
    return predictions.groupBy("customer_id").agg(newest).select("customer_id", "_newest.*")


def latest_with_ties(predictions: DataFrame) -> DataFrame:
    """All rows at each customer's newest timestamp; null customers drop out."""
    newest = predictions.groupBy("customer_id").agg(F.max("created_at").alias("created_at"))
    return predictions.join(newest, ["customer_id", "created_at"]).select(*predictions.columns)


def with_customers(predictions: DataFrame, customers: DataFrame, columns: list[str], how: str = "inner") -> DataFrame:
    attributes = customers.select(F.col(c.ID).alias("customer_id"), *columns)
    return predictions.join(attributes, "customer_id", how)


def latest_customers(predictions: DataFrame, customers: DataFrame) -> DataFrame:
    """Latest predictions (ties kept) with the attributes the summaries use."""
    return with_customers(latest_with_ties(predictions), customers,
                          ["MonthlyCharges", "Contract", "tenure", "InactiveDays"])


def customers_by_risk(customers: DataFrame, predictions: DataFrame, risk: str | None = None) -> DataFrame:
    """Customers with their latest score, one risk band if given."""
    wanted = ["prediction_label", "churn_probability", "risk_score"]
    score = latest_per_customer(predictions, wanted).select(F.col("customer_id").alias(c.ID), *wanted)
    if risk is None:
        return customers.join(score, c.ID, "left")
    return customers.join(score.where(F.col("prediction_label") == risk), c.ID)


def prediction_history(predictions: DataFrame, customer_id=None) -> DataFrame:
    """Scores newest first: one customer's, or all customers' in one range-partitioned sort."""
    columns = ["customer_id", "prediction_id", "churn_probability", "risk_score", "prediction_label", "churn_label",
               "model_used", "created_at"]
    newest = [F.desc("created_at"), F.desc("prediction_id")]
    if customer_id is not None:
        return predictions.where(F.col("customer_id") == customer_id).select(*columns).orderBy(*newest)
    return predictions.select(*columns).orderBy("customer_id", *newest)


def list_predictions(predictions: DataFrame, customers: DataFrame, risk: str | None = None) -> DataFrame:
    """Predictions with customer attributes, newest first; one band if given."""
    if risk is not None:
        predictions = predictions.where(F.col("prediction_label") == risk)
    return with_customers(predictions, customers, ["MonthlyCharges", "Contract", "tenure"], "left").orderBy(
        F.desc("created_at"), F.desc("prediction_id"))


def risk_distribution(predictions: DataFrame) -> DataFrame:
    return latest_per_customer(predictions, ["prediction_label"]).groupBy("prediction_label").agg(F.count("*").alias("customers"))


def daily_trend(predictions: DataFrame, as_of=None, days: int = TREND_DAYS) -> DataFrame:
    """Count, High and Medium counts and mean probability per day of the last days."""
    start = moment(as_of, predictions) - F.make_dt_interval(F.lit(days))
    label = F.col("prediction_label")
    return (
        predictions.where(F.col("created_at") >= start).groupBy(F.to_date("created_at").alias("day"))
        .agg(F.count("*").alias("total"), F.count_if(label == "High").alias("high"),
             F.count_if(label == "Medium").alias("medium"),
             half_even(exact_avg(F.col("churn_probability")), 4).alias("avg_prob"))
        .orderBy("day")
    )


def short_trend(predictions: DataFrame, as_of=None, days: int = TREND_DAYS) -> DataFrame:
    """Count and unrounded mean probability per day of the last days."""
    start = moment(as_of, predictions) - F.make_dt_interval(F.lit(days))
    return (
        predictions.where(F.col("created_at") >= start).groupBy(F.to_date("created_at").alias("day"))
        .agg(F.count("*").alias("cnt"), exact_avg(F.col("churn_probability")).alias("avg_prob")).orderBy("day")
    )


def top_churn_customers(latest: DataFrame, n: int = TOP_CUSTOMERS) -> DataFrame:
    """Riskiest customers of the latest predictions."""
    return latest.orderBy(F.desc("churn_probability"), "prediction_id").limit(n).select(
        "customer_id", "churn_probability", "risk_score", "prediction_label", "MonthlyCharges", "Contract", "tenure")


def combine_rows(frames: dict[str, DataFrame]) -> DataFrame:
    """One-row frames side by side, each a scalar subquery; a later frame wins on equal names."""
    spark = next(iter(frames.values())).sparkSession
    owner = {x: name for name, frame in frames.items() for x in frame.columns}
    rows = spark.range(1).select(*[f.select(F.struct("*")).scalar().alias(n) for n, f in frames.items()])
    return rows.select(*[F.col(n)[x].alias(x) for x, n in owner.items()])


def table_totals(customers: DataFrame, predictions: DataFrame, calls: DataFrame, as_of=None) -> DataFrame:
    """Customers, predictions, and API calls on the day of the reference moment."""
    now = moment(as_of, calls)
    return combine_rows({
        "a": customers.agg(F.count("*").alias("total_customers")),
        "b": predictions.agg(F.count("*").alias("total_predictions")),
        "c": calls.where(F.to_date("created_at") == F.to_date(now)).agg(F.count("*").alias("api_calls_today")),
    })


def customer_360(customers: DataFrame, predictions: DataFrame, recommendations: DataFrame) -> DataFrame:
    """Customer with latest prediction and its recommendation set, nested.

    Saving replaces a customer's set, so a set is never larger than the rule table.
    """
    latest = latest_per_customer(predictions)
    nested = latest.select(
        F.col("customer_id").alias(c.ID),
        F.struct(*[x for x in latest.columns if x != "customer_id"]).alias("latest_prediction"))
    entry = F.struct("priority", (-F.col("estimated_savings")).alias("rank"), "rule_name", "recommended_action",
                     "estimated_savings")
    sets = recommendations.groupBy(F.col("customer_id").alias(c.ID)).agg(F.collect_list(entry).alias("r")).select(
        c.ID, F.transform(F.sort_array("r"), lambda e: e.dropFields("rank")).alias("recommendations"))
    return customers.join(nested, c.ID, "left").join(sets, c.ID, "left")


def list_history(activity: DataFrame, user_id=None, entry_type: str | None = None) -> DataFrame:
    """History without payloads, newest first; by owner and type if given."""
    if user_id is not None:
        activity = activity.where(F.col("user_id") == user_id)
    if entry_type is not None:
        activity = activity.where(F.col("entry_type") == entry_type)
    columns = [x for x in activity.columns if x not in ("payload", "result")]
    return activity.select(*columns).orderBy("user_id", F.desc("created_at"), F.desc("history_id"))


def open_history(activity: DataFrame, schema: str = "map<string,string>") -> DataFrame:
    """History with the stored JSON parsed; text that does not parse stays null."""
    stored = [x for x in ("payload", "result") if x in activity.columns]
    return activity.withColumns({x: F.from_json(F.col(x), schema) for x in stored})


def find_user(users: DataFrame, email: str) -> DataFrame:
    return users.where(F.lower("email") == email.lower())


def list_users(users: DataFrame) -> DataFrame:
    """Users newest first, without secrets."""
    wanted = [x for x in ("user_id", "name", "email", "role", "is_active", "created_at") if x in users.columns]
    return users.select(*wanted).orderBy(F.desc("created_at"), "user_id")
