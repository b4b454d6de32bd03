"""Scalar expressions against values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from churnlake.functions import features, revenue, rounding, scoring, text


def column(spark, values, expression, kind="double"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("x"))).collect()]


def test_risk_score(spark):
    assert column(spark, [0.0, 0.2, 0.35, 0.5, 0.65, 0.8, 1.0], scoring.risk_score) == [1, 5, 18, 50, 82, 95, 99]


def test_risk_category_edges(spark):
    found = column(spark, [0.65, 0.6499, 0.35, 0.3499], scoring.risk_category)
    assert found == ["High", "Medium", "Medium", "Low"]


def test_churn_label_is_inclusive(spark):
    assert column(spark, [0.5, 0.4999], scoring.churn_label) == ["Churn", "No Churn"]


def test_half_even(spark):
    assert column(spark, [2.665, 2.675, 0.125, -0.125, 45.135], rounding.half_even) == [2.66, 2.68, 0.12, -0.12, 45.14]


def test_scorecard_personas(spark, personas):
    found = {r[0]: r[1] for r in personas.select("customerID", scoring.scorecard()).collect()}
    # HIGH: .50+.25+.15+.30+.20+.10 clamps; LOW: .50-.20+.00-.25-.35-.10 clamps; MED: .50-.10+.05+.05-.05+.05
    assert found == {"H1": 0.95, "L1": 0.05, "M1": 0.50}


def test_lifetime_value(spark):
    assert column(spark, [79.99, 90.0, 100.0], revenue.lifetime_value) == [1104.52, 1242.74, 1380.82]
    assert column(spark, [100.0], lambda m: revenue.lifetime_value(m, rate=0.0)) == [1560.0]


def test_features(spark):
    rows = [(12, 80.0, "960", 10, "Yes", "No", "Two year", "Mailed check"), (0, 30.0, "abc", 200, "No", "Yes", "Weekly", "Cash"),
            (48, 85.0, " ", 0, "Yes", "Yes", "Month-to-month", "Electronic check")]
    df = spark.createDataFrame(rows, "tenure int, MonthlyCharges double, TotalCharges string, InactiveDays int, "
                                     "PhoneService string, StreamingTV string, Contract string, PaymentMethod string")
    a, b, d = features.engineer_features(df).collect()
    assert a.charge_per_tenure == pytest.approx(6.6667, abs=1e-4) and b.charge_per_tenure == 0.0
    assert (a.service_count, b.service_count, d.service_count) == (1, 1, 2)
    assert (a.engagement_score, b.engagement_score, d.engagement_score) == (5.0, 0.0, 20.0)
    assert (a.tenure_band, b.tenure_band, d.tenure_band) == (1, 0, 2)
    assert (a.charge_band, b.charge_band, d.charge_band) == (2, 0, 2)
    assert (a.total_charge_ratio, b.total_charge_ratio, d.total_charge_ratio) == (1.0, 1.0, 0.0)
    assert (a.contract_risk_score, b.contract_risk_score, d.contract_risk_score) == (0, 1, 2)
    assert (a.payment_risk_score, b.payment_risk_score, d.payment_risk_score) == (2, 1, 3)
    assert (a.has_streaming, b.has_streaming, a.has_security) == (0, 1, 0)


def test_mask_email(spark):
    found = column(spark, ["jane@host.com", "j@host.com", "a@b@c", "plain"], text.mask_email, "string")
    assert found == ["j***@host.com", "***@host.com", "***", "***"]


def test_sanitize(spark):
    assert column(spark, ["\t ab c \n", "x" * 300], text.sanitize, "string") == ["ab c", "x" * 255]
