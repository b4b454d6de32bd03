"""Schemas of the operational tables."""

from __future__ import annotations

from pyspark.sql.types import (
    BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType, TimestampNTZType,
)


def _table(*columns) -> StructType:
    return StructType([StructField(name, kind(), True) for name, kind in columns])


S, I, L, D, B, TS = StringType, IntegerType, LongType, DoubleType, BooleanType, TimestampNTZType

CUSTOMER = _table(
    ("customerID", L), ("gender", S), ("SeniorCitizen", I), ("Partner", S), ("Dependents", S),
    ("tenure", I), ("PhoneService", S), ("MultipleLines", S), ("InternetService", S),
    ("OnlineSecurity", S), ("OnlineBackup", S), ("DeviceProtection", S), ("TechSupport", S),
    ("StreamingTV", S), ("StreamingMovies", S), ("Contract", S), ("PaperlessBilling", S),
    ("PaymentMethod", S), ("MonthlyCharges", D), ("TotalCharges", S), ("InactiveDays", I),
    ("SubscriptionType", S), ("Churn", I),
)
PREDICTION = _table(
    ("prediction_id", L), ("customer_id", L), ("churn_probability", D), ("risk_score", I),
    ("prediction_label", S), ("churn_label", S), ("model_used", S), ("created_at", TS),
)
RECOMMENDATION = _table(
    ("customer_id", L), ("rule_name", S), ("recommended_action", S), ("estimated_savings", D),
    ("priority", I), ("is_completed", B), ("created_at", TS),
)
ALERT = _table(
    ("prediction_id", L), ("customer_id", L), ("alert_type", S), ("risk_category", S),
    ("churn_probability", D), ("email_sent", B), ("message", S), ("created_at", TS),
)
API_CALL = _table(
    ("id", L), ("path", S), ("status_code", I), ("user_id", L), ("duration_ms", D), ("created_at", TS),
)
METRIC = _table(
    ("metric_name", S), ("metric_value", D), ("metric_label", S), ("window_start", TS), ("window_end", TS),
)
ACTIVITY = _table(
    ("history_id", L), ("user_id", L), ("entry_type", S), ("title", S), ("result", S), ("created_at", TS),
)
TABLES = {
    "customers": CUSTOMER, "predictions": PREDICTION, "recommendations": RECOMMENDATION,
    "alerts": ALERT, "api_calls": API_CALL, "metrics": METRIC, "activity": ACTIVITY,
}

# event file as delivered; used by batch and stream readers alike
EVENT = _table(
    ("event_id", L), ("ts", TS), ("user_id", L), ("event_type", S), ("value", D), ("props", S),
)
