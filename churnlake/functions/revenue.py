"""Lifetime value and revenue at risk as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from churnlake import config as c
from churnlake.functions.rounding import half_even


def lifetime_value(charges: Column, months: int = c.REMAINING_MONTHS, margin: float = c.GROSS_MARGIN,
                   rate: float = c.MONTHLY_DISCOUNT) -> Column:
    """Discounted margin of the remaining months; undiscounted and unrounded when rate <= 0."""
    if rate <= 0:
        return charges * margin * months
    annuity = (1 - (1 + rate) ** -months) / rate
    return half_even(charges * margin * F.lit(annuity), 2)


def savings_total(recommendations: Column) -> Column:
    """Monthly savings over an array of recommendations."""
    total = F.aggregate(recommendations, F.lit(0.0), lambda acc, r: acc + r["estimated_savings"])
    return F.coalesce(half_even(total), F.lit(0.0))


def customer_risk(p: Column, charges: Column, recommendations: Column | None = None) -> dict[str, Column]:
    """Expected, worst-case, lifetime and recoverable amounts of one customer."""
    monthly = charges * p
    recoverable = savings_total(recommendations) * 12 if recommendations is not None else F.lit(0.0)
    if recommendations is None:
        top = F.lit(c.NO_ACTION)
    else:
        top = F.coalesce(F.try_element_at(recommendations, F.lit(1))["action"], F.lit(c.NO_ACTION))
    return {
        "expected_monthly_loss": half_even(monthly),
        "expected_annual_loss": half_even(monthly * 12),
        "worst_case_monthly": half_even(charges),
        "ltv_at_risk": half_even(lifetime_value(charges) * p),
        "recoverable_revenue": half_even(recoverable),
        "net_revenue_at_risk": half_even(F.greatest(F.lit(0.0), monthly * 12 - recoverable)),
        "roi_of_intervention": half_even(
            F.when(charges > 0, F.try_divide(recoverable, charges)).otherwise(0.0)),
        "top_action": top,
    }


def simple_risk(p: Column, charges: Column) -> dict[str, Column]:
    """Loss per month and year, and undiscounted lifetime value at risk."""
    return {
        "expected_monthly_loss": half_even(p * charges),
        "expected_annual_loss": half_even(p * charges * 12),
        "ltv_at_risk": half_even(p * charges * c.REMAINING_MONTHS * c.GROSS_MARGIN),
    }
