"""Entity views over the star-schema tables: customers, predictions, API calls, activity, users.

Every view is lazy. The customer view aggregates orders to one row per customer before it joins, so
a customer with very many orders costs one partial-aggregate row per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from churnlake.functions.scoring import churn_label, risk_category, risk_score


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _addon(divisor: int) -> str:
    return (f"CASE WHEN net = 'No' THEN 'No internet service' WHEN floor(k / {divisor}) % 2 = 0 THEN 'Yes' "
            "ELSE 'No' END")


# canonical column -> SQL over the joined customer row
_CUSTOMER_COLUMNS = {
    "customerID": "k",
    "gender": "if(k % 2 = 0, 'Male', 'Female')",
    "SeniorCitizen": "if(k % 25 < 4, 1, 0)",
    "Partner": "if(floor(k / 5) % 2 = 0, 'Yes', 'No')",
    "Dependents": "if(k % 10 < 3, 'Yes', 'No')",
    "tenure": "cast(k % 73 AS int)",
    "PhoneService": "if(k % 10 = 9, 'No', 'Yes')",
    "MultipleLines": "CASE WHEN k % 10 = 9 THEN 'No phone service' WHEN floor(k / 7) % 2 = 0 THEN 'Yes' ELSE 'No' END",
    "InternetService": "net",
    "OnlineSecurity": _addon(11),
    "OnlineBackup": _addon(13),
    "DeviceProtection": _addon(17),
    "TechSupport": _addon(3),
    "StreamingTV": _addon(19),
    "StreamingMovies": _addon(23),
    "Contract": "CASE c_mktsegment WHEN 'MACHINERY' THEN 'One year' WHEN 'FURNITURE' THEN 'Two year' "
                "ELSE 'Month-to-month' END",
    "PaperlessBilling": "if(floor(k / 4) % 2 = 0, 'Yes', 'No')",
    "PaymentMethod": "element_at(array('Electronic check', 'Mailed check', 'Bank transfer (automatic)', "
                     "'Credit card (automatic)'), c_nationkey % 4 + 1)",
    "MonthlyCharges": "charges",
    "TotalCharges": "if(k % 33 = 0, '', cast(cast(floor(charges * (k % 73)) AS bigint) AS string))",
    "InactiveDays": "cast(idle % 91 AS int)",
    "SubscriptionType": "element_at(array('Basic', 'Standard', 'Premium'), cast(floor(k / 6) % 3 + 1 AS int))",
    # the label: two of three signals (long idle, no contract, new), the other way for one customer in ten
    "Churn": "cast((cast(idle % 91 > 45 AS int) + cast(c_mktsegment NOT IN ('MACHINERY', 'FURNITURE') AS int) "
             "+ cast(k % 73 < 24 AS int) >= 2) <> (k % 10 = 3) AS int)",
}


def customers(spark: SparkSession, folder: str) -> DataFrame:
    """One row per customer with the canonical subscription columns and the label."""
    orders = table(spark, folder, "orders")
    last = orders.groupBy("o_custkey").agg(F.max("o_orderdate").alias("last_order"))
    newest = last.agg(F.max("last_order")).scalar()

    joined = (
        table(spark, folder, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
        .join(last, F.col("c_custkey") == F.col("o_custkey"), "left")
        .select(F.col("c_custkey").alias("k"), "c_nationkey", "c_mktsegment",
                F.expr("10 + (c_acctbal + 1000) / 100").alias("charges"),
                F.expr("element_at(array('DSL', 'Fiber optic', 'No'), cast(c_custkey % 3 + 1 AS int))").alias("net"),
                F.coalesce(F.datediff(newest, "last_order"), F.lit(90)).alias("idle"))
    )
    return joined.selectExpr(*[f"{text} AS {name}" for name, text in _CUSTOMER_COLUMNS.items()])


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    return predictions_from_orders(table(spark, folder, "orders"))


def predictions_from_orders(orders: DataFrame) -> DataFrame:
    """Scored history: one row per order, probability from its price; batch or stream."""
    p = F.col("o_totalprice") / 500000
    return orders.select(
        F.col("o_orderkey").alias("prediction_id"),
        F.col("o_custkey").alias("customer_id"),
        p.alias("churn_probability"),
        risk_score(p).alias("risk_score"),
        risk_category(p).alias("prediction_label"),
        churn_label(p).alias("churn_label"),
        F.col("o_orderpriority").alias("model_used"),
        F.col("o_orderdate").alias("created_at"),
    )


def api_calls(spark: SparkSession, folder: str) -> DataFrame:
    return calls_from_events(table(spark, folder, "events"))


def calls_from_events(events: DataFrame) -> DataFrame:
    """API-call log from events; works on a batch frame and on a stream."""
    return events.select(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("path"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status_code"),
        "user_id",
        F.col("value").alias("duration_ms"),
        F.col("ts").alias("created_at"),
    )


def activity(spark: SparkSession, folder: str) -> DataFrame:
    """User history; the title is the event type, the stored result its JSON text."""
    return table(spark, folder, "events").select(
        F.col("event_id").alias("history_id"), "user_id",
        F.col("event_type").alias("entry_type"), F.col("event_type").alias("title"),
        F.col("props").alias("result"), F.col("ts").alias("created_at"),
    )


def users(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct event users with an address; every twentieth address has no @."""
    u = F.col("user_id")
    address = F.concat(F.lit("U"), u, F.when(u % 20 == 0, "").otherwise("@"), F.lit("t"), u % 3, F.lit(".io"))
    return (
        table(spark, folder, "events").groupBy("user_id").agg(F.min("ts").alias("created_at"))
        .select("user_id", address.alias("email"),
                F.element_at(F.array(*[F.lit(r) for r in ("Admin", "viewer", "guest")]),
                             (u % 3 + 1).cast("int")).alias("role"),
                F.concat(F.lit("user "), u).alias("name"), "created_at")
    )


def model_responses(spark: SparkSession, folder: str) -> DataFrame:
    """JSON answers per prediction, some fenced and some cut off, with the customer's charge."""
    p = predictions(spark, folder).select("prediction_id", "customer_id", "churn_probability")
    k = F.col("prediction_id")
    body = F.concat(F.lit('{"churn_probability": '), F.col("churn_probability").cast("decimal(10,8)"),
                    F.lit(', "explanation": "order '), k, F.lit('"'),
                    F.when(k % 7 == 0, ', "segment": "Premium"').otherwise(""),
                    F.when(k % 11 == 0, ', "revenue_risk": {"expected_monthly_loss": 1.5, '
                                        '"expected_annual_loss": 18.0, "ltv_at_risk": 20.25}').otherwise(""),
                    # optional parts of the right and of other types
                    F.when(k % 13 == 0, ', "recommendations": [{"action": "Call", "priority": "high"}]')
                    .when(k % 13 == 1, ', "recommendations": "none"').otherwise(""),
                    F.when(k % 17 == 0, ', "top_risk_factors": [{"factor": "tenure", "impact": "high"}]')
                    .when(k % 17 == 1, ', "top_risk_factors": ["tenure"]').otherwise(""))
    closed = F.when(k % 33 == 0, body).otherwise(F.concat(body, F.lit("}")))
    fenced = F.when(k % 20 == 0, F.concat(F.lit("```json\n"), closed, F.lit("\n```"))).otherwise(closed)
    charges = customers(spark, folder).select(F.col("customerID").alias("customer_id"), "MonthlyCharges")
    return p.select("prediction_id", "customer_id", fenced.alias("response")).join(charges, "customer_id", "left")
