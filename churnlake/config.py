"""Column groups, domains, cut-offs, rates and texts that results depend on."""

from __future__ import annotations

# -- columns ---------------------------------------------------------------------------------------
ID = "customerID"
TARGET = "Churn"
NUMERIC = ["tenure", "MonthlyCharges", "TotalCharges", "InactiveDays"]
BINARY = ["gender", "Partner", "Dependents", "PhoneService", "PaperlessBilling"]
NOMINAL = [
    "MultipleLines", "InternetService", "OnlineSecurity", "OnlineBackup", "DeviceProtection",
    "TechSupport", "StreamingTV", "StreamingMovies", "Contract", "PaymentMethod",
    "SubscriptionType",
]
SERVICES = [
    "PhoneService", "MultipleLines", "OnlineSecurity", "OnlineBackup", "DeviceProtection",
    "TechSupport", "StreamingTV", "StreamingMovies",
]
CLUSTER_FEATURES = [
    "tenure", "MonthlyCharges", "InactiveDays", "churn_probability", "service_count",
    "engagement_score",
]
PROFILE_METRICS = [
    "tenure", "MonthlyCharges", "InactiveDays", "churn_probability", "risk_score", "service_count",
]

# snake_case name -> canonical name
CANONICAL_NAMES = {
    "monthly_charges": "MonthlyCharges",
    "total_charges": "TotalCharges",
    "inactive_days": "InactiveDays",
    "subscription_type": "SubscriptionType",
    "senior_citizen": "SeniorCitizen",
    "phone_service": "PhoneService",
    "multiple_lines": "MultipleLines",
    "internet_service": "InternetService",
    "online_security": "OnlineSecurity",
    "online_backup": "OnlineBackup",
    "device_protection": "DeviceProtection",
    "tech_support": "TechSupport",
    "streaming_tv": "StreamingTV",
    "streaming_movies": "StreamingMovies",
    "paperless_billing": "PaperlessBilling",
    "payment_method": "PaymentMethod",
    "contract": "Contract",
}

# value used when an optional column is absent at scoring time
COLUMN_DEFAULTS = {
    "gender": "Male",
    "SeniorCitizen": 0,
    "Partner": "No",
    "Dependents": "No",
    "PhoneService": "Yes",
    "MultipleLines": "No",
    "InternetService": "DSL",
    "OnlineSecurity": "No",
    "OnlineBackup": "No",
    "DeviceProtection": "No",
    "TechSupport": "No",
    "StreamingTV": "No",
    "StreamingMovies": "No",
    "PaperlessBilling": "No",
    "InactiveDays": 0,
    "SubscriptionType": "Standard",
    "TotalCharges": "0",
}

# -- domains ---------------------------------------------------------------------------------------
CONTRACTS = ["Month-to-month", "One year", "Two year"]
PAYMENTS = [
    "Electronic check", "Mailed check", "Bank transfer (automatic)", "Credit card (automatic)",
]
SUBSCRIPTIONS = ["Basic", "Standard", "Premium"]
ROLES = ["admin", "analyst", "viewer", "retention"]
EMAIL_PATTERN = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
TRUE_TOKENS = ["1", "true", "True"]

# names and tokens recognised in an arbitrary labelled table
TARGET_NAMES = [
    "churn", "churned", "is_churn", "target", "label", "cancelled", "left", "attrition", "exited",
]
POSITIVE_TOKENS = ["yes", "true", "1", "churn", "churned", "left", "cancelled"]

# -- risk and feature tables -----------------------------------------------------------------------
HIGH_RISK = 0.65
MEDIUM_RISK = 0.35
CHURN_THRESHOLD = 0.50
CONTRACT_RISK = {"Month-to-month": 2, "One year": 1, "Two year": 0}
PAYMENT_RISK = {
    "Electronic check": 3,
    "Mailed check": 2,
    "Bank transfer (automatic)": 0,
    "Credit card (automatic)": 0,
}
TENURE_BAND_EDGES = [6, 24, 48]
CHARGE_BAND_EDGES = [35, 65, 85]
HIGH_VALUE_CHARGE = 70

# -- additive scorecard, in hundredths -------------------------------------------------------------
SCORECARD_BASE = 50
SCORECARD_FLOOR, SCORECARD_CEILING = 5, 95
SCORECARD_TENURE = [(6, 25), (12, 15), (24, 5), (48, -10)]      # upper edge, points
SCORECARD_TENURE_ABOVE = -20
SCORECARD_CHARGES = [(80, 15), (50, 5), (20, -15)]              # lower edge, points
SCORECARD_INACTIVE = [(60, 30), (30, 15), (15, 5)]              # lower edge, points
SCORECARD_ACTIVE = -25
SCORECARD_CONTRACT = {"Month-to-month": 20, "One year": -5, "Two year": -35}
SCORECARD_PAYMENT = {
    "Electronic check": 10,
    "Mailed check": 5,
    "Bank transfer (automatic)": -10,
    "Credit card (automatic)": -10,
}

# -- money -----------------------------------------------------------------------------------------
GROSS_MARGIN = 0.65
MONTHLY_DISCOUNT = 0.01
REMAINING_MONTHS = 24
RECOVERY_SHARE = 0.10
DEFAULT_CHARGE = 50.0

# -- recommendations -------------------------------------------------------------------------------
MIN_RECOMMEND_PROBABILITY = 0.30
MAX_RECOMMENDATIONS = 5
NO_ACTION = "No action required."

# -- segments --------------------------------------------------------------------------------------
N_CLUSTERS = 4
SEGMENTS = ["Loyal", "Premium", "Risky", "Inactive"]
KMEANS_STARTS, KMEANS_ITERATIONS = 20, 500

# -- training --------------------------------------------------------------------------------------
SEED = 42
TEST_SHARE = 0.20
ID_LIKE_RATIO = 0.95
MIN_TRAINING_ROWS, MIN_TRAINING_COLUMNS = 50, 2
QUALITY_GATE = {
    "min_accuracy": 0.60, "min_auc": 0.65, "max_auc": 0.99, "min_recall": 0.45, "min_f1": 0.45,
    "min_train_share": 0.65, "max_train_share": 0.90, "max_churn_gap": 0.05,
}

# -- alerts and monitoring -------------------------------------------------------------------------
ALERT_HIGH, ALERT_MEDIUM, ALERT_INACTIVE_DAYS = 0.65, 0.45, 30
NO_ALERT_ACTION = "No specific action."
TRAILING_SECONDS = 900
MAX_PAGE_SIZE = 200

# -- data-quality limits ---------------------------------------------------------------------------
AUDIT_LIMITS = {
    "duplicate_rate": 0.02, "p99_charge": 200, "max_tenure": 200,
    "min_churn_rate": 0.05, "max_churn_rate": 0.70,
}
