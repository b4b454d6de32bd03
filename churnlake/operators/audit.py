"""Data-quality audit of a customer table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from churnlake import config as c
from churnlake.operators.activity import combine_rows
from churnlake.operators.ordering import exact_quantiles
from churnlake.operators.sketches import sketched_quantiles

REQUIRED = ["tenure", "MonthlyCharges", "Contract", "PaymentMethod", "Churn"]


def audit(df: DataFrame, sketched: bool = False) -> DataFrame:
    """Rows (check, value, passed): one aggregate over the table plus the 99th percentile, exact or from a sketch."""
    limits = c.AUDIT_LIMITS
    missing = [x for x in REQUIRED if x not in df.columns]
    checks: list[tuple[str, Column, Column]] = [
        ("required_columns", F.lit(float(len(missing))), F.lit(not missing))]
    if missing:
        return _rows(df.sparkSession.range(1), checks)
    has_id = c.ID in df.columns
    positive = F.col(c.TARGET).cast("string").isin("1", "Yes")
    facts = df.agg(
        F.count("*").alias("n"),
        F.count_if(F.col("tenure") < 0).alias("bad_tenure"),
        F.count_if(F.col("MonthlyCharges") <= 0).alias("bad_charges"),
        F.count_if(~F.col(c.TARGET).cast("string").isin("0", "1", "Yes", "No")).alias("bad_target"),
        F.count_if(~F.col("Contract").isin(c.CONTRACTS)).alias("bad_contract"),
        *([F.countDistinct(c.ID).alias("ids"), F.count_if(F.col(c.ID).isNull()).alias("null_ids")] if has_id else []),
        F.max("tenure").alias("max_tenure"),
        F.avg(positive.cast("int")).alias("churn_rate"),
        *[F.count_if(F.col(x).isNull()).alias(f"null_{x}") for x in ("tenure", "MonthlyCharges", "Contract")])
    quantiles = sketched_quantiles if sketched else exact_quantiles
    p99 = quantiles(df, ["MonthlyCharges"], [0.99]).select(F.col("value").alias("p99"))
    at = F.col
    none = lambda x: (at(x).cast("double"), at(x) == 0)     # noqa: E731
    checks += [
        ("not_empty", at("n").cast("double"), at("n") > 0),
        ("tenure_non_negative", *none("bad_tenure")),
        ("charges_positive", *none("bad_charges")),
        ("target_domain", *none("bad_target")),
        ("contract_domain", *none("bad_contract")),
        ("p99_charge", at("p99"), at("p99") < limits["p99_charge"]),
        ("max_tenure", at("max_tenure").cast("double"), at("max_tenure") <= limits["max_tenure"]),
        ("churn_rate", at("churn_rate"),
         (at("churn_rate") > limits["min_churn_rate"]) & (at("churn_rate") < limits["max_churn_rate"])),
        *[(f"null_{x}", *none(f"null_{x}")) for x in ("tenure", "MonthlyCharges", "Contract")],
    ]
    if has_id:
        distinct = at("ids") + F.least(at("null_ids"), F.lit(1))
        rate = F.coalesce(F.try_divide((at("n") - distinct).cast("double"), at("n")), F.lit(0.0))
        checks.append(("duplicate_rate", rate, rate <= limits["duplicate_rate"]))
    return _rows(combine_rows({"facts": facts, "p99": p99}), checks)


def _rows(one_row: DataFrame, checks: list[tuple[str, Column, Column]]) -> DataFrame:
    entries = [F.struct(F.lit(n).alias("check"), v.alias("value"), F.coalesce(ok, F.lit(False)).alias("passed"))
               for n, v, ok in checks]
    return one_row.select(F.explode(F.array(*entries)).alias("r")).select("r.*")
