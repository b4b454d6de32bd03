"""Full scoring of a customer table: score, segment, actions, revenue, explanation in one nested row."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from churnlake.functions.features import engineer_features
from churnlake.functions.revenue import customer_risk
from churnlake.operators import explain, recommend
from churnlake.operators.cleaning import canonical_columns, column_number, with_defaults
from churnlake.operators.encoding import Encoder
from churnlake.operators.segments import Segmenter
from churnlake.operators.training import score_batch

_VECTOR = "_features"


def with_explanation(scored: DataFrame, encoder: Encoder, model, means: list[float], top_n: int = 10,
                     features: str = _VECTOR) -> DataFrame:
    """The vector's explanation in its place: linear terms where the model has them, else importances."""
    names = encoder.feature_names
    if hasattr(model, "coefficients"):
        out = explain.explain_rows(scored, names, [float(x) for x in model.coefficients], means, top_n, features)
    else:
        out = explain.importance_rows(scored, names, model, top_n, features)
    return out.drop(features)


def score_customers(df: DataFrame, encoder: Encoder, model, segmenter: Segmenter, means: list[float]) -> DataFrame:
    """Every customer with prediction, segment, recommendations, revenue risk and explanation."""
    ready = with_defaults(canonical_columns(df))
    ready = ready.withColumns({x: F.coalesce(column_number(ready, x), F.lit(0.0))
                               for x in ("tenure", "MonthlyCharges", "InactiveDays") if x in ready.columns})
    scored = segmenter.assign(engineer_features(score_batch(ready, encoder, model, features=_VECTOR)))      # one vector for all
    advised = recommend.recommend(scored)
    risk = customer_risk(F.col("churn_probability"), F.col("MonthlyCharges"), F.col("recommendations"))
    priced = advised.withColumn("revenue_risk", F.struct(*[x.alias(n) for n, x in risk.items()]))
    return with_explanation(priced, encoder, model, means).withColumn("model_used", F.lit("best_model"))
