"""Retention recommendations: a rule table evaluated as one array expression per row, no shuffle."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from churnlake import config as c
from churnlake.functions.arrays import unfold
from churnlake.functions.rounding import half_even


@dataclass(frozen=True)
class Rule:
    """``when`` is a SQL predicate over the canonical columns; a null result does not fire."""

    name: str
    when: str
    action: str
    reason: str
    multiplier: float
    priority: int
    segments: tuple[str, ...] = ()


# Names, thresholds, texts, multipliers, priorities and segment affinities.
RULES = [
    Rule("low_tenure_onboarding", "tenure <= 6",
         "Assign a dedicated Customer Success Manager for the first 90 days. "
         "Schedule a weekly check-in call and send a personalised onboarding kit.",
         "Low tenure (≤ 6 months) — new customers churn at 3× the rate.",
         0.15, 1, ("Risky",)),
    Rule("month_to_month_upgrade", "Contract = 'Month-to-month'",
         "Offer a free month when the customer upgrades to an annual contract. "
         "Highlight the 10 % effective discount vs month-to-month pricing.",
         "Month-to-month contract — highest churn risk tier.",
         0.12, 2, ("Risky", "Inactive")),
    Rule("high_monthly_charges_discount", "MonthlyCharges > 70",
         "Apply a 15 % loyalty discount for the next 3 billing cycles. "
         "Bundle with complimentary device protection to increase perceived value.",
         "High monthly charges (> $70) with elevated churn risk.",
         0.15, 2, ("Premium", "Risky")),
    Rule("mid_charges_retention_credit", "MonthlyCharges > 45 AND MonthlyCharges <= 70",
         "Apply a $10 account credit for the next billing cycle. "
         "Pair with a personalised usage summary showing value delivered.",
         "Mid-range charges with month-to-month contract.",
         0.08, 4, ("Risky",)),
    Rule("high_inactivity_reengagement", "InactiveDays > 45",
         "Send a personalised re-engagement email with the top 3 features the "
         "customer has not yet used. Follow up with a push notification after 3 days.",
         "High inactivity (> 45 days) — disengaged customers churn 2× faster.",
         0.10, 1, ("Inactive",)),
    Rule("moderate_inactivity_nudge", "InactiveDays BETWEEN 20 AND 45",
         "Trigger an automated 'We miss you' campaign with a feature highlight reel. "
         "Offer a free 30-day premium trial of an unused add-on service.",
         "Moderate inactivity (20–45 days).",
         0.06, 3, ("Inactive", "Risky")),
    Rule("electronic_check_autopay_discount", "lower(PaymentMethod) LIKE '%electronic check%'",
         "Offer a 5 % auto-pay discount for switching from electronic cheque "
         "to bank transfer or credit card. Simplify the switch with a guided in-app flow.",
         "Electronic cheque payment — highest payment-method churn correlate.",
         0.05, 3, ("Risky",)),
    Rule("fiber_no_security_bundle", "InternetService = 'Fiber optic' AND OnlineSecurity = 'No'",
         "Offer 3 months of free Online Security for Fiber optic customers. "
         "Highlight the value of combined Fiber + Security in the upgrade modal.",
         "Fiber optic without Online Security — high upgrade potential.",
         0.07, 3, ("Premium",)),
    Rule("no_tech_support_trial", "TechSupport = 'No'",
         "Provide a complimentary 30-day 24/7 Tech Support trial. "
         "Send a welcome email with the support hotline and first 5 use cases.",
         "No tech support subscription — high pain-point for churn.",
         0.06, 4, ("Risky",)),
    Rule("senior_citizen_priority_support", "SeniorCitizen = 1",
         "Enrol in Senior Care tier: priority call routing, simplified billing PDF, "
         "and a dedicated account manager for all service queries.",
         "Senior citizen — elevated churn from service friction.",
         0.09, 2, ("Loyal", "Risky")),
    Rule("no_partner_loyalty_reward", "Partner = 'No' AND tenure >= 12",
         "Recognise long-term single-account loyalty with a 'Loyal Member' badge "
         "and a referral bonus: $20 credit for each successful referral.",
         "Long-tenure customer without a partner account.",
         0.05, 5, ("Loyal",)),
    Rule("no_streaming_bundle_offer",
         "StreamingTV = 'No' AND StreamingMovies = 'No' AND coalesce(InternetService, '') <> 'No'",
         "Offer a 'Entertainment Bundle' trial: 2 months of Streaming TV + Movies "
         "at 50 % off. Personalise with genre preferences from browsing history.",
         "Internet customer with no streaming — high upsell and retention value.",
         0.08, 4, ("Premium", "Loyal")),
]

_RULE_COLUMNS = ["tenure", "Contract", "MonthlyCharges", "InactiveDays", "PaymentMethod", "InternetService",
                 "OnlineSecurity", "TechSupport", "SeniorCitizen", "Partner", "StreamingTV", "StreamingMovies"]


def _with_rule_columns(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Absent rule columns as nulls, so that their rules do not fire."""
    absent = [x for x in _RULE_COLUMNS if x not in df.columns]
    return df.withColumns({x: F.lit(None) for x in absent}), absent


def ranked_rules(p: Column, charges: Column, weight: Column, segment: Column | None, rules: list[Rule], cap: int,
                 floor: float) -> Column:
    """Array of the fired rules, ranked by priority, savings, rule order; cut to ``cap``."""
    entries = []
    for number, rule in enumerate(rules, 1):
        priority = F.lit(rule.priority)
        if segment is not None and rule.segments:
            priority = F.when(segment.isin(*rule.segments), max(1, rule.priority - 1)).otherwise(rule.priority)
        savings = half_even(charges * rule.multiplier * weight)
        slim = F.struct(priority.alias("priority"), (-savings).alias("rank"), F.lit(number).alias("number"))
        entries.append(F.when(F.expr(rule.when), slim))
    kept = F.when(p >= floor, cap).otherwise(0)
    ranked = F.slice(F.sort_array(F.array_compact(F.array(*entries))), F.lit(1), kept)
    texts = F.array(*[
        F.struct(F.lit(r.name).alias("rule_name"), F.lit(r.action).alias("action"),
                 F.lit(r.multiplier).alias("multiplier"), F.lit(r.reason).alias("reason")) for r in rules])

    def full(entry):
        text = F.element_at(texts, entry["number"])
        return F.struct(text["rule_name"].alias("rule_name"), text["action"].alias("action"),
                        entry["priority"].alias("priority"), (-entry["rank"]).alias("estimated_savings"),
                        text["multiplier"].alias("savings_multiplier"), text["reason"].alias("triggered_by"))
    return F.transform(ranked, full)


def recommend(df: DataFrame, p: str = "churn_probability", segment: str | None = "segment", rules: list[Rule] | None = None,
              cap: int = c.MAX_RECOMMENDATIONS, floor: float = c.MIN_RECOMMEND_PROBABILITY) -> DataFrame:
    """Append ``recommendations`` and ``top_action``. Rules, cap and floor are the caller's to replace."""
    df, absent = _with_rule_columns(df)
    label = F.col(segment) if segment and segment in df.columns else None
    chance = F.coalesce(F.col(p), F.lit(0.0))
    df = df.withColumns({"_p": chance, "_weight": chance * 0.5 + 0.5,
                         "_charges": F.coalesce(F.col("MonthlyCharges").cast("double"), F.lit(c.DEFAULT_CHARGE))})
    ranked = ranked_rules(F.col("_p"), F.col("_charges"), F.col("_weight"), label, rules or RULES, cap, floor)
    top = F.coalesce(F.try_element_at("recommendations", F.lit(1))["action"], F.lit(c.NO_ACTION))
    return (df.withColumn("recommendations", ranked).withColumn("top_action", top)
            .drop(*absent, "_p", "_weight", "_charges"))


def recommendation_rows(df: DataFrame, key: str = c.ID) -> DataFrame:
    """One row per recommendation, shaped for the recommendation table."""
    return unfold(df, F.col("recommendations"), [F.col(key).alias("customer_id")], "r").select(
        "customer_id", "r.rule_name", F.col("r.action").alias("recommended_action"), "r.estimated_savings",
        "r.priority")


def list_recommendations(recommendations: DataFrame, customers: DataFrame, customer_id=None) -> DataFrame:
    """All recommendations with customer attributes, most urgent and newest first; or one customer's list."""
    if customer_id is not None:
        return recommendations.where(F.col("customer_id") == customer_id).orderBy("priority", F.desc("estimated_savings"))
    attributes = customers.select(F.col(c.ID).alias("customer_id"), "MonthlyCharges", "Contract")
    order = [F.asc("priority")]
    if "created_at" in recommendations.columns:
        order.append(F.desc("created_at"))
    return recommendations.join(attributes, "customer_id", "left").orderBy(*order, "customer_id", "rule_name")
