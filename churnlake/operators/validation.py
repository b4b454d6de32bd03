"""Validation of incoming customer and user tables: accepted rows normalised, rejected rows with reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from churnlake import config as c
from churnlake.operators.cleaning import canonical_columns, column_number, is_number, number
from churnlake.functions.rounding import half_even

# service columns that fall back to "No" when absent
_PLAIN_SERVICES = ["PhoneService", "MultipleLines", "PaperlessBilling", "OnlineSecurity", "OnlineBackup",
                   "DeviceProtection", "TechSupport", "StreamingTV", "StreamingMovies", "Partner", "Dependents"]


def _column(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def _filled(df: DataFrame, name: str, default: str) -> Column:
    """Trimmed text; null or empty falls back."""
    text = F.trim(_column(df, name).cast("string"))
    return F.when(text != "", text).otherwise(default)


def _whole(df: DataFrame, name: str) -> Column:
    """Non-negative int; negatives and unreadable values become 0. Numbers lose their fraction, text must be an int."""
    if name in df.columns and is_number(df, name):
        value = column_number(df, name).try_cast("int")
    else:
        value = _column(df, name).cast("string").try_cast("int")
    return F.greatest(F.coalesce(value, F.lit(0)), F.lit(0))


def _reasons(checks: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(why)) for why, bad in checks.items()]))


def validate_customers(df: DataFrame) -> DataFrame:
    """Normalised rows plus ``reasons``; an empty array means accepted."""
    df = canonical_columns(df)
    charges, contract = number(_column(df, "MonthlyCharges")), F.trim(_column(df, "Contract"))
    payment, total = F.trim(_column(df, "PaymentMethod")), _column(df, "TotalCharges").cast("string")
    blank_total = total.isNull() | (F.trim(total) == "")
    plan, senior = F.trim(_column(df, "SubscriptionType")), _column(df, "SeniorCitizen").cast("string")
    gender = F.trim(_column(df, "gender"))
    reasons = _reasons({
        "missing tenure": _column(df, "tenure").isNull(),
        "missing monthly_charges": _column(df, "MonthlyCharges").isNull(),
        "missing contract": contract.isNull(),
        "missing payment_method": payment.isNull(),
        "monthly_charges must be a non-negative number":
            F.when(_column(df, "MonthlyCharges").isNull(), False).otherwise(charges.isNull() | (charges < 0)),
        "contract is not allowed": F.when(contract.isNull(), False).otherwise(~contract.isin(c.CONTRACTS)),
        "payment_method is not allowed": F.when(payment.isNull(), False).otherwise(~payment.isin(c.PAYMENTS)),
        "total_charges must be a number": F.when(blank_total, False).otherwise(number(total).isNull()),
    })
    normal = {
        "tenure": _whole(df, "tenure"),
        "MonthlyCharges": half_even(charges, 4),
        "InactiveDays": _whole(df, "InactiveDays"),
        "SeniorCitizen": F.when(senior.isin(c.TRUE_TOKENS), 1).otherwise(0),
        "gender": F.when(gender != "", gender),
        "InternetService": _filled(df, "InternetService", "DSL"),
        "Contract": contract,
        "PaymentMethod": payment,
        "SubscriptionType": F.when(plan.isin(c.SUBSCRIPTIONS), plan).otherwise("Standard"),
        **{x: _filled(df, x, "No") for x in _PLAIN_SERVICES},
    }
    default_total = half_even(charges, 4) * _whole(df, "tenure")
    normal["TotalCharges"] = F.when(blank_total, default_total).otherwise(number(total))
    return df.withColumns({**normal, "reasons": reasons})


def validate_users(df: DataFrame) -> DataFrame:
    """Users with trimmed name, lower-case address, known role, and ``reasons``."""
    name, email = F.trim("name"), F.col("email")
    role = F.lower(F.col("role"))
    reasons = _reasons({
        "name must have at least 2 characters": F.length(name) < 2,
        "invalid email address": ~email.rlike(c.EMAIL_PATTERN),
    })
    return df.withColumns({
        "name": name, "email": F.trim(F.lower(email)),
        "role": F.when(role.isin(c.ROLES), role).otherwise("viewer"), "reasons": reasons,
    })


def accepted(validated: DataFrame) -> DataFrame:
    return validated.where(F.size("reasons") == 0).drop("reasons")


def rejected(validated: DataFrame) -> DataFrame:
    return validated.where(F.size("reasons") > 0)
