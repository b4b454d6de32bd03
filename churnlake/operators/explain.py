"""Linear contributions per row and overall, and the model-importance fallback."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from churnlake.functions.rounding import half_even
from churnlake.operators.evaluation import model_weights

_UP, _DOWN = "increases_churn", "decreases_churn"


def background_means(matrix: DataFrame, features: str = "features") -> list[float]:
    """Mean of every feature over the background rows."""
    return [float(x) for x in matrix.select(Summarizer.mean(F.col(features)).alias("m")).first()["m"]]


def _terms(names: list[str], coefficients: list[float], means: list[float]) -> Column:
    return F.array(*[F.struct(F.lit(n).alias("feature"), F.lit(float(k)).alias("k"), F.lit(float(m)).alias("m"))
                     for n, k, m in zip(names, coefficients, means)])


def explain_rows(matrix: DataFrame, names: list[str], coefficients: list[float], means: list[float],
                 top_n: int = 10, features: str = "features") -> DataFrame:
    """Append ``explanation``: the largest contributions coef x (value - mean), no shuffle."""
    def entry(x, term):
        part = term["k"] * (x - term["m"])
        return F.struct((-F.abs(part)).alias("rank"), term["feature"].alias("feature"), x.alias("feature_value"),
                        half_even(part, 6).alias("shap_value"),
                        F.when(part > 0, "positive").otherwise("negative").alias("impact"))
    ranked = F.sort_array(F.zip_with(vector_to_array(features), _terms(names, coefficients, means), entry))
    slim = F.transform(F.slice(ranked, 1, top_n), lambda e: e.dropFields("rank"))
    return matrix.withColumn("explanation", slim)


def importance_rows(matrix: DataFrame, names: list[str], model, top_n: int = 10, features: str = "features") -> DataFrame:
    """Fallback for models without linear terms: the same ranking by model importance for every row."""
    weights = model_weights(model)
    order = sorted(range(len(names)), key=lambda i: (-weights[i], names[i]))[:top_n]
    values = vector_to_array(features)
    entries = [F.struct(F.lit(names[i]).alias("feature"), values[i].alias("feature_value"),
                        F.lit(round(weights[i], 6)).alias("shap_value"), F.lit("positive").alias("impact"))
               for i in order]
    return matrix.withColumn("explanation", F.array(*entries))


def global_importance(matrix: DataFrame, names: list[str], coefficients: list[float], means: list[float],
                      top_n: int = 15, features: str = "features") -> DataFrame:
    """Mean absolute contribution and the sign of the mean, one pass with a vector summary."""
    parts = F.zip_with(vector_to_array(features), _terms(names, coefficients, means),
                       lambda x, term: term["k"] * (x - term["m"]))
    from pyspark.ml.functions import array_to_vector
    summary = matrix.select(array_to_vector(parts).alias("parts")).select(
        Summarizer.metrics("count", "mean", "normL1").summary(F.col("parts")).alias("s"))
    rows = summary.select("s.count", F.posexplode(F.arrays_zip(
        vector_to_array("s.mean").alias("mean"), vector_to_array("s.normL1").alias("total"))).alias("i", "v"))
    label = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("i") + 1)
    return (
        rows.select(label.alias("feature"), (F.col("v.total") / F.col("count")).alias("importance"),
                    F.when(F.col("v.mean") > 0, _UP).otherwise(_DOWN).alias("direction"))
        .orderBy(F.desc("importance"), "feature").limit(top_n)
        .withColumn("importance", half_even(F.col("importance"), 6))
    )


def global_importance_fallback(importances: DataFrame) -> DataFrame:
    """Model importances with the direction left at 'increases'."""
    return importances.withColumn("direction", F.lit(_UP))


# Fixed text: the wording of the narrative.
def narrative(p: Column, explanation: Column) -> Column:
    """One or two sentences: probability, drivers and protective factors among the top five."""
    top = F.slice(explanation, 1, 5)

    def named(impact: str, most: int) -> Column:
        chosen = F.filter(top, lambda e: e["impact"] == impact)
        return F.array_join(F.transform(F.slice(chosen, 1, most), lambda e: e["feature"]), ", ")
    drivers, protective = named("positive", 3), named("negative", 2)
    percent = half_even(p * 100, 0).cast("int").cast("string")
    return F.concat(
        F.lit("This customer has a "), percent, F.lit("% probability of churning. "),
        F.when(drivers != "", F.concat(F.lit("The primary drivers are: "), drivers, F.lit(". "))).otherwise(""),
        F.when(protective != "", F.concat(F.lit("Protective factors include: "), protective, F.lit("."))).otherwise(""))


def explain_customers(explained: DataFrame, p: str = "churn_probability") -> DataFrame:
    """Top five factors split by sign, and the narrative."""
    top = F.slice("explanation", 1, 5)
    return explained.withColumns({
        "top_risk_factors": top,
        "positive_drivers": F.filter(top, lambda e: e["impact"] == "positive"),
        "negative_drivers": F.filter(top, lambda e: e["impact"] == "negative"),
        "explanation_text": narrative(F.col(p), F.col("explanation")),
    })


def flatten(explanation: Column) -> Column:
    """Map from feature to contribution."""
    return F.map_from_entries(F.transform(
        explanation, lambda e: F.struct(e["feature"], F.coalesce(e["shap_value"], F.lit(0.0)))))


EXPLANATION_SCHEMA = "array<struct<feature: string, feature_value: double, shap_value: double, impact: string>>"


def to_text(explanation: Column) -> Column:
    """JSON text for the prediction table; null when there is nothing to store."""
    return F.when(F.size(explanation) > 0, F.to_json(explanation))


def from_text(text: Column) -> Column:
    return F.from_json(text, EXPLANATION_SCHEMA)
