"""Batch summaries, custom-model scoring and normalisation of model responses."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from churnlake import config as c
from churnlake.functions.revenue import simple_risk
from churnlake.functions.rounding import exact_avg, half_even
from churnlake.functions.scoring import churn_label, risk_category
from churnlake.operators.ordering import with_row_number
from churnlake.operators.training import CustomModel

PREVIEW_ROWS = 100
_PREVIEW = ["churn_probability", "risk_score", "risk_category", "churn_label"]

# the parts of a model's answer; each is parsed for itself, so that an odd optional part doesn't spoil the rest
_FACTORS = "array<struct<factor: string, impact: string, detail: string>>"
_ADVICE = "array<struct<action: string, priority: string, estimated_savings: string, triggered_by: string>>"
_RISK = "struct<expected_monthly_loss: string, expected_annual_loss: string, ltv_at_risk: string>"


def batch_summary(scored: DataFrame) -> DataFrame:
    """Totals by band and the mean probability as one row."""
    band = F.col("risk_category")
    return scored.agg(
        F.count("*").alias("total"), F.count_if(band == "High").alias("high_risk"),
        F.count_if(band == "Medium").alias("medium_risk"), F.count_if(band == "Low").alias("low_risk"),
        half_even(exact_avg(F.col("churn_probability")), 4).alias("avg_churn_probability"))


def batch_preview(scored: DataFrame, order: list[Column]) -> DataFrame:
    """First rows in the given order, score columns only."""
    return scored.orderBy(*order).limit(PREVIEW_ROWS).select(*_PREVIEW)


def score_custom(df: DataFrame, custom: CustomModel) -> DataFrame:
    """Scores of a custom model: whole-percent score, two segments, undiscounted revenue at risk."""
    packed = df.withColumn("_row", F.struct("*"))
    scored = custom.model.transform(custom.vectors(packed, ["_row"])).select(
        "_row.*", vector_to_array("probability")[1].alias("_p"))
    p = F.col("_p")
    name = next((x for x in ("monthly_charges", "MonthlyCharges") if x in df.columns), None)
    charges = F.coalesce(F.col(name).cast("double"), F.lit(c.DEFAULT_CHARGE)) if name else F.lit(c.DEFAULT_CHARGE)
    return scored.withColumns({
        "churn_probability": half_even(p, 4),
        "risk_score": half_even(p * 100, 0).cast("int"),
        "risk_category": risk_category(p),
        "churn_label": churn_label(p),
        "segment": F.when(p >= c.HIGH_RISK, "Risky").otherwise("Loyal"),
        "model_used": F.lit(f"custom/{custom.name}"),
        "industry": F.lit(custom.meta.get("industry", "custom")),
        "revenue_risk": F.struct(*[x.alias(n) for n, x in simple_risk(p, charges).items()]),
    }).drop("_p")


_ADVISED = "array<struct<action: string, priority: int, estimated_savings: double, triggered_by: string>>"


def _none(kind: str) -> Column:
    return F.array().cast(kind)


def _list_or_empty(col: Column, kind: str) -> Column:
    """The entries that could be read; an empty array where there are none."""
    return F.coalesce(F.filter(col, lambda x: F.to_json(x) != "{}"), _none(kind))


def unfence(text: Column) -> Column:
    """Text inside a leading code fence, without its language tag."""
    stripped = F.btrim(text, F.lit(" \t\n\r"))
    inner = F.try_element_at(F.split(stripped, "```"), F.lit(2))
    inner = F.when(inner.startswith("json"), F.substr(inner, F.lit(5))).otherwise(inner)
    return F.btrim(F.when(stripped.startswith("```"), inner).otherwise(stripped), F.lit(" \t\n\r"))


def normalise_responses(df: DataFrame, response: str = "response", charges: str = "MonthlyCharges",
                        order: list[Column] | None = None) -> DataFrame:
    """Parse JSON answers; clamp, re-derive and fill; unreadable answers become a neutral row.

    With ``order`` the rows are numbered from 1, before any parsing.
    """
    if order:
        df = with_row_number(df, order)
    def part(name: str) -> Column:
        return F.get_json_object("_text", f"$.{name}")

    given = F.col("_given")
    value = F.when(given.isNull(), F.lit(0.5)).otherwise(given.try_cast("double"))
    ok = F.col("_object") & F.col("_value").isNotNull() & ~F.isnan("_value")
    advice = F.transform(F.col("_advice"), lambda x: F.struct(
        x["action"].alias("action"), x["priority"].try_cast("int").alias("priority"),
        x["estimated_savings"].try_cast("double").alias("estimated_savings"), x["triggered_by"].alias("triggered_by")))
    numbers = {n: F.col(f"_risk.{n}").try_cast("double") for n in ("expected_monthly_loss", "expected_annual_loss", "ltv_at_risk")}
    p = F.when(ok, F.greatest(F.lit(0.05), F.least(F.lit(0.95), F.col("_value")))).otherwise(0.5)
    monthly = F.coalesce(F.nullif(F.col(charges), F.lit(0.0)), F.lit(c.DEFAULT_CHARGE))
    risk = simple_risk(F.col("_p"), monthly)
    stated = ok & (F.coalesce(numbers["expected_annual_loss"], F.lit(0.0)) != 0)
    return (
        df.withColumn("_text", unfence(F.col(response)))
        # a map of texts accepts any object and nothing else
        .withColumn("_object", F.coalesce(F.size(F.map_keys(F.from_json("_text", "map<string, string>", {"mode": "PERMISSIVE"}))) >= 0,
                                          F.lit(False)) & F.col("_text").startswith("{"))
        .withColumns({"_given": part("churn_probability"), "_segment": part("segment"), "_explanation": part("explanation"),
                      "_factors": F.from_json(part("top_risk_factors"), _FACTORS),
                      "_advice": F.from_json(part("recommendations"), _ADVICE),
                      "_risk": F.from_json(part("revenue_risk"), _RISK)})
        .withColumn("_value", value).withColumn("_p", p)
        .select(
            *df.columns,
            half_even(F.col("_p"), 4).alias("churn_probability"),
            half_even(F.col("_p") * 100, 0).cast("int").alias("risk_score"),
            risk_category(F.col("_p")).alias("risk_category"),
            F.when(ok, churn_label(F.col("_p"))).otherwise("Unknown").alias("churn_label"),
            F.when(ok, F.coalesce("_segment", F.when(F.col("_p") >= c.HIGH_RISK, "Risky").otherwise("Loyal")))
            .otherwise("Unknown").alias("segment"),
            F.when(ok, F.coalesce("_explanation", F.lit("")))
            .otherwise("Could not parse AI response. Please try again.").alias("explanation"),
            F.when(ok, _list_or_empty(F.col("_factors"), _FACTORS)).otherwise(_none(_FACTORS)).alias("top_risk_factors"),
            F.when(ok, _list_or_empty(advice, _ADVISED)).otherwise(_none(_ADVISED)).alias("recommendations"),
            *[F.when(stated, numbers[n]).otherwise(x).alias(n) for n, x in risk.items()],
        )
    )
