"""Recommendations, revenue and scenarios on personas."""

import pytest
from pyspark.sql import functions as F

from churnlake.functions.revenue import customer_risk
from churnlake.operators import portfolio, recommend, scenarios


def advised(personas, **options):
    return {r.customerID: r for r in recommend.recommend(personas, **options).collect()}


def test_high_persona_ranking(personas):
    recs = advised(personas, segment=None)["H1"].recommendations
    assert [(r.rule_name, r.estimated_savings, r.priority) for r in recs] == [
        # 84 * multiplier * (0.7 / 2 + 0.5)
        ("low_tenure_onboarding", 10.71, 1), ("high_inactivity_reengagement", 7.14, 1),
        ("high_monthly_charges_discount", 10.71, 2), ("month_to_month_upgrade", 8.57, 2),
        ("senior_citizen_priority_support", 6.43, 2)]


def test_low_probability_gets_nothing(personas):
    row = advised(personas)["L1"]
    assert row.recommendations == [] and row.top_action == "No action required."


def test_segment_moves_priority_up(personas):
    recs = advised(personas.withColumn("segment", F.lit("Premium")))["H1"].recommendations
    assert {r.rule_name: r.priority for r in recs}["high_monthly_charges_discount"] == 1


def test_custom_rules_cap_and_floor(personas):
    rules = [recommend.Rule("everyone", "tenure >= 0", "Call.", "Always.", 0.5, 3),
             recommend.Rule("broken", "cast(null as boolean)", "Never.", "Never.", 0.5, 1)]
    found = advised(personas, rules=rules, cap=1, floor=0.0)
    assert all([r.rule_name for r in row.recommendations] == ["everyone"] for row in found.values())


def test_customer_risk(personas):
    df = recommend.recommend(personas, segment=None)
    risk = customer_risk(F.col("churn_probability"), F.col("MonthlyCharges"), F.col("recommendations"))
    row = df.where("customerID = 'H1'").select(*[x.alias(n) for n, x in risk.items()]).first()
    assert (row.expected_annual_loss, row.recoverable_revenue, row.net_revenue_at_risk) == (705.6, 522.72, 182.88)
    assert (row.roi_of_intervention, row.ltv_at_risk, row.worst_case_monthly) == (6.22, 811.92, 84.0)


def test_portfolio(spark):
    df = spark.createDataFrame([(80.0, 0.8), (50.0, 0.5), (30.0, 0.2)], "MonthlyCharges double, churn_probability double")
    row = portfolio.portfolio_risk(df).first()
    assert (row.expected_monthly_loss, row.expected_annual_loss, row.worst_case_annual_loss) == (95.0, 1140.0, 960.0)
    assert (row.recoverable_revenue_annual, row.net_revenue_at_risk_annual, row.total_ltv_at_risk) == (114.0, 1026.0, 1311.78)
    assert (row.high_risk_count, row.medium_risk_count, row.low_risk_count) == (1, 1, 1)
    with pytest.raises(ValueError):
        portfolio.portfolio_risk(df.drop("MonthlyCharges"))


def test_risk_by_segment(spark):
    df = spark.createDataFrame([(80.0, 0.8, "Risky"), (50.0, 0.2, "Loyal")],
                               "MonthlyCharges double, churn_probability double, segment string")
    found = {r.segment: r.expected_annual_loss for r in portfolio.risk_by_segment(df).collect()}
    assert found == {"Risky": 768.0, "Loyal": 120.0}


def test_savings_of_empty_array(personas):
    found = {r.customerID: r.estimated_savings
             for r in portfolio.with_savings(recommend.recommend(personas, segment=None)).collect()}
    assert found["L1"] == 0.0 and found["H1"] == 43.56


def test_scenarios(personas):
    rows = {(r.customerID, r.scenario): r for r in scenarios.simulate(personas).collect()}
    assert len(rows) == 3 * len(scenarios.PRESETS)
    bundle = rows["H1", "full_retention_bundle"]       # .50+.25+.15-.25-.05-.10
    assert (bundle.base_churn_probability, bundle.new_churn_probability, bundle.delta_probability) == (0.95, 0.50, -0.45)
    assert bundle.monthly_revenue_saved == 37.8 and bundle.improvement_pct == 47.4
    assert rows["H1", "add_tech_support"].delta_probability == 0.0


def test_scale_comes_before_override(spark):
    df = spark.createDataFrame([(1, 100.0, "A")], "customerID int, MonthlyCharges double, Contract string")
    changed = scenarios.apply_scenarios(df, {"x": {"scale": {"MonthlyCharges": 0.855}}, "y": {
        "scale": {"MonthlyCharges": 0.5}, "set": {"MonthlyCharges": 7.0, "Contract": "B"}}})
    assert {r.scenario: (r.MonthlyCharges, r.Contract) for r in changed.collect()} == {"x": (85.5, "A"), "y": (7.0, "B")}


def test_sweep(personas):
    rows = scenarios.sweep_means(scenarios.sweep(personas, "tenure", [1, 60])).collect()
    assert [r.value for r in rows] == [1, 60] and rows[0].avg_churn_probability > rows[1].avg_churn_probability
