"""The registered queries: every operator over the whole tables of a data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from churnlake import config as c, schemas
from churnlake.functions import revenue, scoring, text
from churnlake.functions.arrays import unfold
from churnlake.functions.features import engineer_features, feature_columns
from churnlake.functions.rounding import half_even
from churnlake.operators import (
    activity, alerts, audit, autoprep, bucketed, cleaning, encoding, evaluation, explain, maintenance, model_scoring, monitoring,
    ordering, paging, portfolio, recommend, scenarios, segments, sketches, splitting, training, validation,
)
from churnlake.plans import batch_run, customer_scoring, entities, summary
from churnlake.session import cut_lineage, intermediate_tables, over_all_cores, staged, work_path
from churnlake.sources import adapters, files
from churnlake.streaming import monitors

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# A linear model given by hand, one coefficient per feature in feature order.
COEFFICIENTS = [round(((i * 37) % 19 - 9) / 10 + 0.05 + i / 1000, 3) for i in range(40)]

# User-supplied rules.
CUSTOM_RULES = [
    recommend.Rule("paperless_push", "PaperlessBilling = 'No'", "Offer paperless billing.", "Paper bills.", 0.03, 2),
    recommend.Rule("long_dsl", "InternetService = 'DSL' AND tenure > 24", "Offer a fiber trial.", "Old DSL line.",
                   0.20, 1, ("Loyal",)),
    recommend.Rule("big_family", "Dependents = 'Yes' AND Partner = 'Yes'", "Offer a family plan.", "Family.", 0.11, 1),
]


def query(run: Query) -> Query:
    """Register under the function's name; timestamps are read in UTC."""
    def in_utc(spark: SparkSession, folder: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return run(spark, folder)
    QUERIES[run.__name__] = in_utc
    return in_utc


_customers, _predictions, _calls = adapters.customers, adapters.predictions, adapters.api_calls


# -- sources and sinks -----------------------------------------------------------------------------
def _raw(spark, folder) -> DataFrame:
    """Customers as they arrive: padded text, unreadable totals, every row twice."""
    df = _customers(spark, folder)
    padded = df.withColumns({
        **{f.name: F.col(f.name).cast("string") for f in df.schema},
        "Contract": F.concat(F.lit("  "), "Contract", F.lit("\t")),
        "PaymentMethod": F.concat("PaymentMethod", F.lit(" ")),
        "TotalCharges": F.when(F.col("customerID") % 50 == 7, "abc").otherwise(F.col("TotalCharges")),
        "Churn": F.when(F.col("Churn") == 1, "Yes").otherwise("No"),
    })
    return padded.unionByName(padded)


_CLEAN = ["customerID", "gender", "SeniorCitizen", "tenure", "Contract", "PaymentMethod", "MonthlyCharges",
          "TotalCharges", "InactiveDays", "Churn"]


def _long_id(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*columns).withColumn("customerID", F.col("customerID").cast("bigint"))


@query
def raw_csv_scan(spark, folder):
    path = work_path(spark, "raw-csv")
    _raw(spark, folder).write.option("header", True).option("ignoreLeadingWhiteSpace", False) \
        .option("ignoreTrailingWhiteSpace", False).csv(path)
    return _long_id(cleaning.clean_customers(files.read_raw_customers(spark, path)), _CLEAN)


def _snake(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({new: old for old, new in c.CANONICAL_NAMES.items()})


@query
def scoring_csv_scan(spark, folder):
    path = work_path(spark, "scoring-csv")
    _snake(_customers(spark, folder).drop("Churn")).write.option("header", True).csv(path)
    df = cleaning.canonical_columns(files.read_scoring_csv(spark, path))
    return model_scoring.batch_summary(scoring.with_scorecard(df))


@query
def training_csv_scan(spark, folder):
    path = work_path(spark, "training-csv")
    df = _customers(spark, folder).withColumn("region", F.lit("Québec"))
    df.write.options(header=True, encoding="ISO-8859-1").csv(path)
    return files.read_training_csv(spark, path).groupBy("region", "Contract").agg(
        F.count("*").alias("rows"), F.sum("Churn").alias("churners"), F.max("tenure").alias("max_tenure"))


@query
def table_scans(spark, folder):
    base = work_path(spark, "tables")
    frames = {
        "customers": _customers(spark, folder), "predictions": _predictions(spark, folder),
        "recommendations": entities.recommendation_table(spark, folder), "alerts": entities.alert_table(spark, folder),
        "api_calls": _calls(spark, folder), "activity": adapters.activity(spark, folder),
        "metrics": monitoring.metric_points(_calls(spark, folder)),
    }
    for name, frame in frames.items():
        files.append_rows(frame, base, name)
    files.register_tables(spark, base)
    counts = [spark.sql(f"SELECT '{name}' AS table_name, count(*) AS rows FROM {name}") for name in schemas.TABLES]
    out = counts[0]
    for frame in counts[1:]:
        out = out.unionByName(frame)
    return out


@query
def cleaned_sink(spark, folder):
    path = work_path(spark, "cleaned")
    files.write_cleaned(cleaning.clean_customers(_raw(spark, folder)), path)
    return _long_id(spark.read.parquet(path), _CLEAN)


_SCORES = ["customerID", "churn_probability", "risk_score", "risk_category", "churn_label", "top_action"]


@query
def scored_sink(spark, folder):
    path = work_path(spark, "scored")
    files.write_scored(entities.recommended_customers(spark, folder), path)
    return spark.read.parquet(path).select(*_SCORES)


@query
def scored_csv_export(spark, folder):
    path = work_path(spark, "export")
    files.export_scored_csv(entities.recommended_customers(spark, folder), path)
    return files.read_scoring_csv(spark, path).select(
        F.col("customerID").cast("bigint").alias("customerID"), F.col("churn_probability").cast("double"),
        F.col("risk_score").cast("int"), "risk_category", "churn_label", "top_action")


@query
def run_report(spark, folder):
    """The whole batch job; returns its JSON report."""
    result = batch_run.run_batch(_raw(spark, folder), work_path(spark, "run"))
    return result.report


@query
def append_sink(spark, folder):
    base = work_path(spark, "append")
    calls = _calls(spark, folder)
    files.append_rows(calls.where(F.col("status_code") < 500), base, "api_calls")
    files.append_rows(calls.where(F.col("status_code") >= 500), base, "api_calls")
    files.append_rows(monitoring.metric_points(calls), base, "metrics")
    by_path = files.read_table(spark, base, "api_calls").groupBy("path").agg(F.count("*").alias("calls"))
    points = files.read_table(spark, base, "metrics").groupBy("metric_label").agg(
        F.sum("metric_value").alias("points"), F.count("*").alias("hours"))
    return by_path.join(points, by_path.path == points.metric_label).select("path", "calls", "points", "hours")


# -- table maintenance -----------------------------------------------------------------------------
@query
def append_predictions(spark, folder):
    old = _predictions(spark, folder)
    new = entities.scored_customers(spark, folder).select(
        F.col("customerID").alias("customer_id"), "churn_probability", "risk_score",
        F.col("risk_category").alias("prediction_label"), "churn_label", F.lit("scorecard").alias("model_used"))
    numbered = maintenance.with_new_ids(new, old, "prediction_id", [F.col("customer_id")])
    return maintenance.append(old, numbered)


@query
def replace_recommendations(spark, folder):
    old = entities.recommendation_table(spark, folder).select(
        "customer_id", "rule_name", "estimated_savings", "priority")
    new = recommend.recommendation_rows(entities.recommended_customers(spark, folder)).drop("recommended_action")
    return maintenance.replace_by_key(old, cut_lineage(new), "customer_id")     # the new set is read twice


@query
def update_customers(spark, folder):
    customers = _customers(spark, folder).select("customerID", "tenure", "Contract", "MonthlyCharges", "gender")
    latest = activity.latest_per_customer(_predictions(spark, folder))
    high = F.col("prediction_label") == "High"
    changes = latest.select(
        F.col("customer_id").alias("customerID"), F.lit("One year").alias("Contract"), high.alias("set_Contract"),
        F.when(~high, F.lit(600)).alias("tenure"), F.lit("Other").alias("gender"))
    return maintenance.update_by_key(customers, changes, "customerID", maintenance.CUSTOMER_UPDATES,
                                     F.to_timestamp_ntz(F.lit("2024-02-01 00:00:00")))


@query
def delete_history(spark, folder):
    history = adapters.activity(spark, folder)
    doomed = _calls(spark, folder).where(F.col("status_code") >= 500).select(
        F.col("id").alias("history_id"), "user_id")
    return maintenance.delete_by_key(history, doomed, ["history_id", "user_id"]).select(
        "history_id", "user_id", "entry_type")


@query
def cascade_delete(spark, folder):
    doomed = _customers(spark, folder).where(F.col("Churn") == 1).select(F.col("customerID").alias("customer_id"))
    kept = maintenance.cascade_delete(
        {"predictions": _predictions(spark, folder), "alerts": entities.alert_table(spark, folder),
         "recommendations": entities.recommendation_table(spark, folder)}, doomed, "customer_id")
    sizes = [f.groupBy("customer_id").agg(F.count("*").alias("rows")).withColumn("table_name", F.lit(n))
             for n, f in kept.items()]
    return sizes[0].unionByName(sizes[1]).unionByName(sizes[2])


@query
def unlink_alerts(spark, folder):
    predictions = _predictions(spark, folder)
    doomed = predictions.where(F.col("churn_label") == "No Churn")
    return maintenance.set_null_by_key(entities.alert_table(spark, folder), doomed, "prediction_id").select(
        "prediction_id", "customer_id", "alert_type", "created_at")


@query
def insert_new_users(spark, folder):
    table = adapters.users(spark, folder).select("email", "user_id")
    new = _customers(spark, folder).select(
        F.concat(F.lit("U"), "customerID", F.lit("@t"), F.col("customerID") % 3, F.lit(".io")).alias("email"),
        F.col("customerID").alias("user_id"))
    return maintenance.insert_if_absent(table, new.unionByName(new.withColumn("user_id", F.col("user_id") + 5)),
                                        "email", ["user_id"])


def _stored(spark, df: DataFrame, name: str, key: str, buckets: int = 16) -> bucketed.BucketedTable:
    return bucketed.BucketedTable.create(df, work_path(spark, name), key, buckets)


@query
def bucketed_update(spark, folder):
    """Long contracts for the customers of the newest day's High predictions, in the buckets of these customers only."""
    table = _stored(spark, _customers(spark, folder).select("customerID", "tenure", "Contract", "MonthlyCharges", "gender"), "customers", "customerID")
    predictions = _predictions(spark, folder)
    newest = predictions.where(F.col("created_at") == predictions.agg(F.max("created_at")).scalar())
    changes = newest.where("prediction_label = 'High'").select(F.col("customer_id").alias("customerID"), F.lit("Two year").alias("Contract"),
                                                              F.lit("Other").alias("gender")).distinct()
    table.update(changes, maintenance.CUSTOMER_UPDATES)
    return table.read()


@query
def bucketed_changes(spark, folder):
    """Append, delete, replace and insert-if-absent, one after the other, on a stored activity table."""
    history = adapters.activity(spark, folder).select("history_id", "user_id", "entry_type")
    table = _stored(spark, history.where(F.col("history_id") % 10 != 0), "activity", "history_id")
    table.append(history.where(F.col("history_id") % 10 == 0))
    table.delete(history.where(F.col("history_id") % 7 == 0).select("history_id"))
    table.replace(history.where(F.col("history_id") % 9 == 0).withColumn("entry_type", F.lit("replaced")))
    table.insert_if_absent(history.where(F.col("history_id") % 14 == 0).withColumn("entry_type", F.lit("again")), ["user_id"])
    return table.read()


@query
def update_users(spark, folder):
    """Name, role and state of users may change, their address may not."""
    users = adapters.users(spark, folder).select("user_id", "email", "role", "name").withColumn("is_active", F.lit(True))
    u = F.col("user_id")
    changes = users.select("user_id", F.when(u % 4 == 0, F.lit("admin")).alias("role"), F.lit("nobody@t0.io").alias("email"),
                           F.lit(False).alias("is_active"), (u % 3 == 0).alias("set_is_active"))
    return maintenance.update_by_key(users, changes, "user_id", maintenance.USER_UPDATES)


@query
def update_alerts(spark, folder):
    """Delivery state of alerts: failed ones get an address and a status, other columns stay."""
    alerts_ = entities.alert_table(spark, folder).select("prediction_id", "customer_id", "email_sent", "risk_category").withColumns(
        {"email_address": F.lit(None).cast("string"), "email_status": F.lit("new")})
    failed = alerts_.where(~F.col("email_sent")).select(
        "prediction_id", F.lit(True).alias("email_sent"), F.concat(F.lit("c"), "customer_id", F.lit("@t.io")).alias("email_address"),
        F.lit("sent").alias("email_status"), F.lit("Low").alias("risk_category"))
    return maintenance.update_by_key(alerts_, failed, "prediction_id", maintenance.ALERT_UPDATES)


# -- cleaning and encoding -------------------------------------------------------------------------
@query
def cleaned_customers(spark, folder):
    return _long_id(cleaning.clean_customers(_raw(spark, folder)), _CLEAN)


@query
def duplicate_report(spark, folder):
    return cleaning.duplicate_report(cleaning.trim_text(_raw(spark, folder)))


@query
def binary_encoding(spark, folder):
    return cleaning.binary_encode(_customers(spark, folder)).select("customerID", *c.BINARY)


@query
def canonical_with_defaults(spark, folder):
    slim = _snake(_customers(spark, folder)).select(
        "customerID", "tenure", "monthly_charges", "contract", "payment_method", "inactive_days")
    return cleaning.with_defaults(cleaning.canonical_columns(slim))


def _incoming(spark, folder) -> DataFrame:
    """Customer records with missing, unreadable and out-of-domain fields."""
    k = F.col("customerID")
    return _snake(_customers(spark, folder)).withColumns({
        "tenure": F.when(k % 40 == 3, F.lit(None)).when(k % 40 == 4, -5).otherwise(F.col("tenure")).cast("string"),
        "monthly_charges": F.when(k % 41 == 5, "free").when(k % 41 == 6, "-3").when(k % 41 == 7, F.lit(None))
        .otherwise(F.col("monthly_charges").cast("string")),
        "contract": F.when(k % 43 == 8, "Weekly").otherwise(F.concat(F.lit(" "), "contract")),
        "payment_method": F.when(k % 47 == 9, F.lit(None)).otherwise(F.col("payment_method")),
        "subscription_type": F.when(k % 5 == 0, "Gold").otherwise(F.col("subscription_type")),
        "senior_citizen": F.when(F.col("senior_citizen") == 1, "true").otherwise("0"),
        "total_charges": F.when(k % 53 == 11, "n/a").otherwise(F.col("total_charges")),
    }).drop("Partner")


@query
def accepted_customers(spark, folder):
    good = validation.accepted(validation.validate_customers(_incoming(spark, folder)))
    return good.select("customerID", "tenure", "MonthlyCharges", "TotalCharges", "InactiveDays", "SeniorCitizen",
                       "Contract", "PaymentMethod", "SubscriptionType", "Partner", "InternetService")


@query
def rejected_customers(spark, folder):
    bad = validation.rejected(validation.validate_customers(_incoming(spark, folder)))
    return bad.select("customerID", F.array_join("reasons", "; ").alias("reasons"))


@query
def validated_users(spark, folder):
    return validation.validate_users(adapters.users(spark, folder)).select(
        "user_id", "name", "email", "role", F.array_join("reasons", "; ").alias("reasons"))


def _encoder_input(spark, folder) -> DataFrame:
    return training.model_input(_customers(spark, folder), drop_duplicates=True)


@query
def encoded_features(spark, folder):
    """Z-scored numbers, one-hot words and flags as columns."""
    ready = _encoder_input(spark, folder)
    encoder = encoding.fit_encoder(ready)
    return ready.select("customerID", *[half_even(col, 6).alias(n) for n, col in encoder.feature_columns().items()])


@query
def feature_matrix(spark, folder):
    """The assembled vectors, read back as (customer, position, value)."""
    from pyspark.ml.functions import vector_to_array
    ready = _encoder_input(spark, folder)
    matrix = encoding.fit_encoder(ready).matrix(ready, keep=["customerID"])
    rows = unfold(matrix, vector_to_array("features"), ["customerID"], "value", "place")
    return rows.select("customerID", (F.col("place") - 1).alias("position"), half_even(F.col("value"), 6).alias("value"))


@query
def stratified_split(spark, folder):
    split = splitting.stratified_split(_customers(spark, folder))
    return split.groupBy("Churn", "split").agg(F.count("*").alias("rows"))


def _labelled(spark, folder) -> DataFrame:
    """A labelled table of unknown shape: gaps, text target, numeric and text columns."""
    k = F.col("customerID")
    return _customers(spark, folder).select(
        "customerID", "gender", F.when(k % 9 != 0, F.col("tenure")).alias("tenure"), "MonthlyCharges",
        F.when(k % 8 != 0, F.col("Contract")).alias("Contract"), F.when(k % 7 != 0, F.col("PaymentMethod")).alias("PaymentMethod"),
        "InactiveDays", F.when(F.col("Churn") == 1, "Left").otherwise("stayed").alias("Customer_Churned"))


@query
def auto_prepared_table(spark, folder):
    """Total of every prepared column of a labelled table."""
    return autoprep.feature_totals(autoprep.auto_prepare(_labelled(spark, folder)))


# -- features --------------------------------------------------------------------------------------
@query
def customer_features(spark, folder):
    df = engineer_features(_customers(spark, folder))
    return df.select("customerID", *feature_columns(df.columns))


# -- scoring ---------------------------------------------------------------------------------------
@query
def risk_scores(spark, folder):
    return _predictions(spark, folder).select(
        "prediction_id", "churn_probability", "risk_score", "prediction_label", "churn_label",
        scoring.churn_label(F.col("churn_probability"), 0.8).alias("strict_label"))


@query
def scorecard(spark, folder):
    return scoring.with_scorecard(_customers(spark, folder)).select(
        "customerID", "churn_probability", "churn_label", "risk_score", "risk_category")


@query
def batch_scores(spark, folder):
    return entities.recommended_customers(spark, folder).select(*_SCORES)


@query
def batch_summary(spark, folder):
    return model_scoring.batch_summary(entities.scored_customers(spark, folder))


@query
def batch_preview(spark, folder):
    """First hundred scored customers."""
    return model_scoring.batch_preview(entities.scored_customers(spark, folder), [F.col("customerID")])


@query
def normalised_responses(spark, folder):
    df = model_scoring.normalise_responses(adapters.model_responses(spark, folder), order=[F.col("prediction_id")])
    return df.select("row_number", "prediction_id", "churn_probability", "risk_score", "risk_category", "churn_label",
                     "segment", "explanation", "expected_monthly_loss", "expected_annual_loss", "ltv_at_risk",
                     F.array_join(F.col("top_risk_factors.factor"), ",").alias("factors"),
                     F.array_join(F.col("recommendations.action"), ",").alias("actions"))


_ARTEFACTS: dict[tuple, str] = {}


def _artefact(spark, folder, name: str, make: Callable[[str], None]) -> str:
    """The path of a trained artefact: trained and written once per application and folder, then loaded by every query."""
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _ARTEFACTS:
        path = work_path(spark, name)
        with intermediate_tables(spark):        # only what was saved stays
            make(path)
        _ARTEFACTS[key] = path
    return _ARTEFACTS[key]


def _run_path(spark, folder) -> str:
    def make(path: str) -> None:
        run = training.train_customers(_customers(spark, folder))
        training.save_run(run, path)
        run.release()

    return _artefact(spark, folder, "models", make)


def _training_run(spark, folder) -> training.TrainingRun:
    return training.load_run(spark, _run_path(spark, folder))


def _custom_path(spark, folder) -> str:
    return _artefact(spark, folder, "custom", lambda path: training.save_custom(
        training.train_custom(_labelled(spark, folder), ["customerID"], industry="telecom"), spark, path))


def _segmenter_path(spark, folder) -> str:
    return _artefact(spark, folder, "segments", lambda path: segments.fit_segments(
        engineer_features(entities.scored_customers(spark, folder))).save(spark, path))


def _segmenter(spark, folder) -> segments.Segmenter:
    return segments.Segmenter.load(spark, _segmenter_path(spark, folder))


@query
def model_scores(spark, folder):
    run = _training_run(spark, folder)
    return training.score_batch(over_all_cores(_customers(spark, folder)), run.encoder, run.best_model).select(
        "customerID", "churn_probability", "churn_label", "risk_score", "risk_category")


@query
def raw_probabilities(spark, folder):
    run = _training_run(spark, folder)
    return training.raw_probabilities(over_all_cores(_customers(spark, folder)), run.encoder, run.best_model).select(
        "customerID", "p0", "p1")


@query
def saved_model_scores(spark, folder):
    """Load the saved best model, score."""
    encoder, model, _ = training.load_model(spark, _run_path(spark, folder))
    return training.score_batch(over_all_cores(_customers(spark, folder)), encoder, model).select(
        "customerID", "churn_probability", "risk_category")


@query
def full_customer_scoring(spark, folder):
    run = _training_run(spark, folder)
    means = explain.background_means(run.train)
    return customer_scoring.score_customers(
        over_all_cores(_customers(spark, folder)), run.encoder, run.best_model, _segmenter(spark, folder), means).select(
        "customerID", "churn_probability", "risk_score", "risk_category", "churn_label", "segment",
        "recommendations", "revenue_risk", "explanation", "model_used")


@query
def custom_model_scores(spark, folder):
    """Train on a labelled table of unknown shape, save, load, score another shape."""
    loaded = training.load_custom(spark, _custom_path(spark, folder))
    return model_scoring.score_custom(over_all_cores(_customers(spark, folder)), loaded).select(
        "customerID", "churn_probability", "risk_score", "risk_category", "churn_label", "segment", "model_used",
        "industry", "revenue_risk")


# -- training and evaluation -----------------------------------------------------------------------
def _labelled_scores(spark, folder) -> DataFrame:
    return entities.scored_customers(spark, folder).select(F.col("Churn").alias("label"), "churn_probability", "Contract")


@query
def model_comparison(spark, folder):
    """Three trained models on the held-out rows."""
    return _training_run(spark, folder).metrics().drop("seconds")


@query
def evaluation_metrics(spark, folder):
    return evaluation.evaluate(_labelled_scores(spark, folder), by=["Contract"])


@query
def class_report(spark, folder):
    return evaluation.class_report(_labelled_scores(spark, folder))


@query
def confusion_matrix(spark, folder):
    return evaluation.confusion_matrix(_labelled_scores(spark, folder))


@query
def roc_curve(spark, folder):
    return evaluation.roc_points(_labelled_scores(spark, folder)).select(
        "threshold", "pos", "neg", half_even(F.col("fpr"), 6).alias("fpr"), half_even(F.col("tpr"), 6).alias("tpr"))


@query
def roc_auc(spark, folder):
    return evaluation.roc_auc(_labelled_scores(spark, folder), by=["Contract"])


@query
def feature_importance(spark, folder):
    run = _training_run(spark, folder)
    return evaluation.feature_importance(spark, run.best_model, run.features)


@query
def quality_gate(spark, folder):
    best = _training_run(spark, folder).metrics().where("best")
    return evaluation.quality_gate(best)


@query
def custom_training(spark, folder):
    custom = training.load_custom(spark, _custom_path(spark, folder))
    rows = [(n, r["accuracy"], r["f1"], r["roc_auc"], n == custom.kind) for n, r in custom.meta["model_results"].items()]
    return spark.createDataFrame(rows, "model string, accuracy double, f1 double, roc_auc double, best boolean")


# -- explanations ----------------------------------------------------------------------------------
def _explained(spark, folder) -> DataFrame:
    """Contributions of the hand-given linear model; the background is the customers who stayed."""
    ready = _encoder_input(spark, folder)
    encoder = encoding.fit_encoder(ready)
    matrix = encoder.matrix(ready, keep=["customerID", "Churn"])
    names = encoder.feature_names
    means = explain.background_means(matrix.where(F.col("Churn") == 0))
    return explain.explain_rows(matrix, names, COEFFICIENTS[:len(names)], means)


@query
def row_explanations(spark, folder):
    rows = unfold(_explained(spark, folder), F.col("explanation"), ["customerID"], "e", "place")
    return rows.select("customerID", "place", "e.feature",
                       half_even(F.col("e.feature_value"), 6).alias("feature_value"), "e.shap_value", "e.impact")


@query
def global_importance(spark, folder):
    ready = _encoder_input(spark, folder)
    encoder = encoding.fit_encoder(ready)
    matrix = encoder.matrix(ready, keep=["Churn"])
    names = encoder.feature_names
    means = explain.background_means(matrix.where(F.col("Churn") == 0))
    return explain.global_importance(matrix, names, COEFFICIENTS[:len(names)], means)


@query
def importance_fallback(spark, folder):
    run = _training_run(spark, folder)
    tops = evaluation.feature_importance(spark, run.models["random_forest"], run.features, 15)
    return explain.global_importance_fallback(tops)


@query
def importance_fallback_rows(spark, folder):
    run = _training_run(spark, folder)
    ready = training.model_input(over_all_cores(_customers(spark, folder)), run.encoder.medians["TotalCharges"])
    matrix = run.encoder.matrix(ready, keep=["customerID"])
    return explain.importance_rows(matrix, run.features, run.models["random_forest"]).select("customerID", "explanation")


@query
def narratives(spark, folder):
    scores = entities.scored_customers(spark, folder).select("customerID", "churn_probability")
    return explain.explain_customers(_explained(spark, folder).join(scores, "customerID")).select(
        "customerID", F.size("positive_drivers").alias("positive"), F.size("negative_drivers").alias("negative"),
        "explanation_text")


@query
def stored_explanations(spark, folder):
    """Explanations to JSON text and back, then as a map."""
    stored = _explained(spark, folder).select("customerID", explain.to_text(F.col("explanation")).alias("shap_values"))
    back = stored.select("customerID", explain.flatten(explain.from_text(F.col("shap_values"))).alias("m"))
    return unfold(back, F.map_entries("m"), ["customerID"], "e").select(
        "customerID", F.col("e.key").alias("feature"), F.col("e.value").alias("shap_value"))


# -- segments --------------------------------------------------------------------------------------
@query
def cluster_features(spark, folder):
    df = engineer_features(entities.scored_customers(spark, folder))
    return segments.cluster_features(df, ["customerID"])


@query
def cluster_segments(spark, folder):
    df = engineer_features(entities.scored_customers(spark, folder))
    return _segmenter(spark, folder).assign(df).select("customerID", "cluster_id", "segment")


@query
def cluster_profile(spark, folder):
    df = engineer_features(entities.scored_customers(spark, folder)).drop("segment")
    path = work_path(spark, "segmenter")
    _segmenter(spark, folder).save(spark, path)
    return segments.segment_profile(segments.Segmenter.load(spark, path).assign(df))


@query
def segment_profile(spark, folder):
    return segments.segment_profile(engineer_features(entities.scored_customers(spark, folder)))


@query
def rule_segments(spark, folder):
    return segments.rule_segment_summary(_latest(spark, folder))


# -- recommendations -------------------------------------------------------------------------------
def _recommendation_rows(df: DataFrame) -> DataFrame:
    rows = unfold(df, F.col("recommendations"), ["customerID"], "r", "place")
    return rows.select("customerID", "place", "r.rule_name", "r.action", "r.priority",
                       "r.estimated_savings", "r.savings_multiplier", "r.triggered_by")


@query
def recommendations(spark, folder):
    return _recommendation_rows(entities.recommended_customers(spark, folder))


@query
def recommendations_without_segment(spark, folder):
    return _recommendation_rows(recommend.recommend(entities.scored_customers(spark, folder), segment=None))


@query
def top_actions(spark, folder):
    return entities.recommended_customers(spark, folder).select(
        "customerID", F.size("recommendations").alias("actions"), "top_action")


@query
def custom_rules(spark, folder):
    df = recommend.recommend(entities.scored_customers(spark, folder), rules=CUSTOM_RULES, cap=2, floor=0.2)
    return _recommendation_rows(df).select("customerID", "place", "rule_name", "priority", "estimated_savings")


@query
def recommendation_list(spark, folder):
    return recommend.list_recommendations(entities.recommendation_table(spark, folder), _customers(spark, folder)).select(
        "customer_id", "rule_name", "recommended_action", "priority", "estimated_savings", "created_at",
        "MonthlyCharges", "Contract")


# -- revenue ---------------------------------------------------------------------------------------
@query
def lifetime_value(spark, folder):
    m = F.col("MonthlyCharges")
    return _customers(spark, folder).select(
        "customerID", revenue.lifetime_value(m).alias("ltv"), revenue.lifetime_value(m, 36).alias("ltv_36"),
        half_even(revenue.lifetime_value(m, rate=0.0), 4).alias("ltv_undiscounted"))


@query
def customer_revenue_risk(spark, folder):
    df = entities.recommended_customers(spark, folder)
    risk = revenue.customer_risk(F.col("churn_probability"), F.col("MonthlyCharges"), F.col("recommendations"))
    return df.select("customerID", "churn_probability", "risk_category", *[x.alias(n) for n, x in risk.items()])


@query
def portfolio_risk(spark, folder):
    return portfolio.portfolio_risk(portfolio.with_savings(entities.recommended_customers(spark, folder)))


@query
def portfolio_risk_without_actions(spark, folder):
    return portfolio.portfolio_risk(entities.scored_customers(spark, folder))


@query
def risk_by_segment(spark, folder):
    return portfolio.risk_by_segment(entities.scored_customers(spark, folder))


@query
def savings_per_customer(spark, folder):
    return portfolio.with_savings(entities.recommended_customers(spark, folder)).select("customerID", "estimated_savings")


@query
def portfolio_stats(spark, folder):
    return portfolio.portfolio_stats(entities.scored_customers(spark, folder))


@query
def segment_distribution(spark, folder):
    return portfolio.segment_distribution(entities.scored_customers(spark, folder))


def _latest(spark, folder) -> DataFrame:
    return activity.latest_customers(_predictions(spark, folder), _customers(spark, folder))


@query
def live_annual_loss(spark, folder):
    return portfolio.live_annual_loss(_latest(spark, folder))


# -- scenarios -------------------------------------------------------------------------------------
@query
def scenario_results(spark, folder):
    return scenarios.simulate(_customers(spark, folder)).drop("exact_charges")


@query
def scenario_totals(spark, folder):
    return scenarios.scenario_totals(scenarios.simulate(_customers(spark, folder)))


@query
def model_scenario_totals(spark, folder):
    run = _training_run(spark, folder)
    scored = scenarios.simulate(over_all_cores(_customers(spark, folder)), scorer=training.scorer(run.encoder, run.best_model))
    return scenarios.scenario_totals(scored)


@query
def tenure_sweep(spark, folder):
    return scenarios.sweep_means(scenarios.sweep(_customers(spark, folder), "tenure", [1, 12, 24, 36, 48, 60]))


# -- operations ------------------------------------------------------------------------------------
@query
def latest_prediction(spark, folder):
    return activity.latest_per_customer(_predictions(spark, folder))


@query
def latest_predictions_with_ties(spark, folder):
    return _latest(spark, folder)


@query
def high_risk_customers(spark, folder):
    return activity.customers_by_risk(_customers(spark, folder), _predictions(spark, folder), "High").select(
        "customerID", "Contract", "MonthlyCharges", "prediction_label", "churn_probability", "risk_score")


@query
def prediction_history(spark, folder):
    return activity.prediction_history(_predictions(spark, folder))


@query
def prediction_list(spark, folder):
    return activity.list_predictions(_predictions(spark, folder), _customers(spark, folder), "Medium")


@query
def prediction_page(spark, folder):
    """Third page of the newest predictions, by the index of that order."""
    def make(path: str) -> None:
        paging.PageIndex.create(_predictions(spark, folder), "prediction_id", [("created_at", True), ("prediction_id", True)], path)

    index = paging.PageIndex(spark, _artefact(spark, folder, "page-index", make), "prediction_id", paging.SLICE_ROWS, "bigint")
    return index.page(_predictions(spark, folder), 3, 50)


@query
def bucketed_page(spark, folder):
    """A page whose rows are read from the buckets of their keys alone."""
    base, order = work_path(spark, "bucketed-page"), [("churn_probability", True), ("prediction_id", False)]
    predictions = _predictions(spark, folder)
    table = bucketed.BucketedTable.create(predictions, f"{base}/table", "prediction_id", 32)
    return paging.PageIndex.create(predictions, "prediction_id", order, f"{base}/index", 500).page(table, 12, 45)


@query
def numbered_predictions(spark, folder):
    """Position of every prediction in the newest-first list, the basis of deep pages."""
    return ordering.with_row_number(_predictions(spark, folder), [F.desc("created_at"), F.desc("prediction_id")]).select(
        "row_number", "prediction_id")


@query
def page_info(spark, folder):
    return ordering.page_info(_predictions(spark, folder), 3, 500)


@query
def risk_distribution(spark, folder):
    return activity.risk_distribution(_predictions(spark, folder))


@query
def short_trend(spark, folder):
    return activity.short_trend(_predictions(spark, folder))


@query
def daily_trend(spark, folder):
    return activity.daily_trend(_predictions(spark, folder))


@query
def top_churn_customers(spark, folder):
    return activity.top_churn_customers(_latest(spark, folder))


@query
def table_totals(spark, folder):
    return activity.table_totals(_customers(spark, folder), _predictions(spark, folder), _calls(spark, folder))


@query
def executive_summary(spark, folder):
    return summary.executive_summary(_customers(spark, folder), _predictions(spark, folder), _calls(spark, folder),
                                     entities.scored_customers(spark, folder))


@query
def executive_report(spark, folder):
    """The summary with nested trend and top customers."""
    return summary.executive_report(_customers(spark, folder), _predictions(spark, folder), _calls(spark, folder),
                                    entities.scored_customers(spark, folder))


@query
def customer_360(spark, folder):
    df = activity.customer_360(_customers(spark, folder), _predictions(spark, folder),
                               entities.recommendation_table(spark, folder))
    latest, recs = F.col("latest_prediction"), F.col("recommendations")
    return df.select(
        "customerID", "Contract", "tenure", "MonthlyCharges", latest["prediction_id"].alias("prediction_id"),
        latest["churn_probability"].alias("churn_probability"), latest["created_at"].alias("created_at"),
        F.coalesce(F.size(recs), F.lit(0)).alias("actions"),
        F.array_join(F.transform(recs, lambda r: r["rule_name"]), ",").alias("rules"))


@query
def history_list(spark, folder):
    return activity.list_history(adapters.activity(spark, folder), entry_type="purchase")


@query
def opened_history(spark, folder):
    return activity.open_history(adapters.activity(spark, folder), "struct<k: bigint>").select(
        "history_id", "user_id", "entry_type", F.col("result.k").alias("k"))


@query
def user_by_email(spark, folder):
    """Case-insensitive lookup of one address."""
    return activity.find_user(adapters.users(spark, folder), "u7@T1.io").select("user_id", "email", "name")


@query
def user_list(spark, folder):
    return activity.list_users(adapters.users(spark, folder))


# -- monitoring and alerts -------------------------------------------------------------------------
@query
def trailing_totals(spark, folder):
    return monitoring.trailing_totals(_calls(spark, folder), "duration_ms")


@query
def trailing_series(spark, folder):
    return monitoring.trailing_series(_calls(spark, folder), ["path"], "duration_ms")


@query
def prediction_counters(spark, folder):
    return monitoring.prediction_counters(_predictions(spark, folder))


@query
def latency_by_band(spark, folder):
    """Prediction counters with latency, over calls; unknown bands count as Low."""
    return monitoring.prediction_counters(_calls(spark, folder), "path", "duration_ms")


@query
def top_endpoints(spark, folder):
    return monitoring.top_endpoints(_calls(spark, folder))


@query
def error_rate(spark, folder):
    return monitoring.error_rate(_calls(spark, folder))


@query
def active_users(spark, folder):
    return monitoring.active_users(_calls(spark, folder))


@query
def hourly_calls(spark, folder):
    return monitoring.hourly_calls(_calls(spark, folder))


_ALERT = ["prediction_id", "customer_id", "alert_type", "risk_category", "churn_probability", "message", "created_at"]


@query
def churn_alerts(spark, folder):
    return entities.alert_table(spark, folder).select(*_ALERT)


@query
def recent_alerts(spark, folder):
    """Newest fifty High alerts."""
    return alerts.recent_alerts(entities.alert_table(spark, folder), risk="High").select(*_ALERT)


@query
def alert_stats(spark, folder):
    return alerts.alert_stats(entities.alert_table(spark, folder))


@query
def monitoring_dashboard(spark, folder):
    """The dashboard row; its nested lists as text, one entry after the other."""
    row = monitoring.dashboard(_predictions(spark, folder), _calls(spark, folder))

    def listed(name: str, *fields: str):
        return F.array_join(F.transform(name, lambda x: F.concat_ws(":", *[x[f].cast("string") for f in fields])), ";").alias(name)

    plain = [x for x in row.columns if x not in ("top_endpoints", "prediction_trend", "hourly_calls")]
    return row.select(*plain, listed("top_endpoints", "path", "calls"),
                      listed("prediction_trend", "day", "total", "high", "medium"),
                      F.array_join(F.transform("hourly_calls", lambda x: F.concat_ws(
                          ":", F.date_format(x["hour"], "yyyyMMddHH"), x["calls"])), ";").alias("hourly_calls"))


@query
def daily_usage(spark, folder):
    return monitoring.daily_usage(_calls(spark, folder), _predictions(spark, folder),
                                  entities.recommendation_table(spark, folder))


LATENESS = 3600         # seconds a pane stays open


def _event_stream(spark, folder) -> DataFrame:
    return monitors.event_stream(spark, f"{folder}/events.parquet*")


def _panes(spark, folder, name: str, seconds: int) -> monitors.PaneLog:
    log = monitors.run_panes(_event_stream(spark, folder), name, seconds, LATENESS)
    log.merge_late()
    return log


@query
def stream_call_windows(spark, folder):
    """Tumbling 15-minute windows, open ones included."""
    out = _panes(spark, folder, "tumbling", 900).windows()
    return out.select("window_start", "window_end", "calls", "errors", F.col("duration").cast("double").alias("duration"))


@query
def stream_trailing_windows(spark, folder):
    """Sliding 15-minute windows every 5 minutes, open ones included, from panes of 5 minutes."""
    return _panes(spark, folder, "sliding", 300).windows(900, 300).select("window_start", "window_end", "calls", "errors")


@query
def stream_metric_points(spark, folder):
    """Tumbling hours as rows of the metrics table; the approximate user count is in stream_active_users."""
    points = monitors.call_metrics(_panes(spark, folder, "points", 900).windows(3600))
    return points.where(F.col("metric_name") != "active_users").drop("metric_label")


@query
def stream_active_users(spark, folder):
    """Approximate distinct users per hour from the sketches of the panes."""
    return _panes(spark, folder, "users", 900).windows(3600).select("window_start", "calls", "users")


@query
def stream_daily_users(spark, folder):
    """Users a day, rolled up from the sketches of the stream's panes, and whether that is within 5 % of the exact batch count."""
    estimates = monitors.daily_users(_panes(spark, folder, "days", 900).panes())
    exact = _calls(spark, folder).groupBy(F.to_date("created_at").alias("day")).agg(
        F.countDistinct(F.when(F.col("user_id") != 0, F.col("user_id"))).alias("exact"))
    off = F.abs(F.col("active_users") - F.col("exact"))
    return estimates.join(exact, "day", "full").select("day", "exact", (20 * off <= F.greatest("exact", F.lit(20))).alias("within_bound"))


@query
def stream_late_rows(spark, folder):
    """The event files read newest day first, a file a trigger: calls that came too late, and windows before and after they are merged."""
    events = adapters.table(spark, folder, "events")
    path = work_path(spark, "event-days")
    names = [r["day"] for r in events.select(F.to_date("ts").alias("day")).distinct().orderBy(F.desc("day")).limit(2).collect()]
    log = None
    for day in names:            # the stream stops and goes on between the two days
        events.where(F.to_date("ts") == F.lit(day)).write.mode("append").parquet(path)
        log = monitors.run_panes(monitors.event_stream(spark, path), "late", 900, LATENESS, path=f"{path}-log")
    before = log.windows(86400).select("window_start", F.col("calls").alias("calls_before"))
    before = staged(before, "late-before")
    late = log.late_rows().groupBy(F.date_trunc("day", "created_at").cast("timestamp_ntz").alias("window_start")).agg(
        F.count("*").alias("late"))
    late = staged(late, "late-counts")
    log.merge_late()
    after = log.windows(86400).select("window_start", "calls", "errors")
    return after.join(before, "window_start", "left").join(late, "window_start", "left").na.fill(0, ["calls_before", "late"])


@query
def stream_call_log(spark, folder):
    """The call stream appended to the log table."""
    return monitors.run_available(adapters.calls_from_events(_event_stream(spark, folder)), "log")


@query
def stream_alerts(spark, folder):
    """Alerts of the prediction stream; equal to the batch alerts."""
    orders = adapters.table(spark, folder, "orders")
    stream = spark.readStream.schema(orders.schema).parquet(f"{folder}/orders.parquet*")
    found = monitors.alert_stream(adapters.predictions_from_orders(stream), _customers(spark, folder))
    return monitors.run_available(found, "alerts").select(*_ALERT)


@query
def sketched_quantiles(spark, folder):
    """Quantiles of order prices by priority from sketches merged over order days, and whether their true rank is within the stated error."""
    priced = _predictions(spark, folder).select("model_used", F.to_date("created_at").alias("day"), "churn_probability")
    days = sketches.quantile_sketches(priced, ["churn_probability"], ["model_used", "day"])
    found = sketches.quantiles_of_sketches(sketches.merged_sketches(days, ["model_used"]), [0.1, 0.5, 0.9])
    found = cut_lineage(found.select("model_used", "probability", "value"))         # a row for each priority and probability
    ranks = priced.join(F.broadcast(found), "model_used").groupBy("model_used", "probability").agg(
        F.avg((F.col("churn_probability") < F.col("value")).cast("double")).alias("low"),
        F.avg((F.col("churn_probability") <= F.col("value")).cast("double")).alias("high"), F.count("*").alias("rows"))
    error = 2 * sketches.rank_error()
    return ranks.select("model_used", "probability", "rows",
                        ((F.col("low") - error <= F.col("probability")) & (F.col("probability") <= F.col("high") + error)).alias("within_bound"))


# -- scalars and audit -----------------------------------------------------------------------------
@query
def masked_emails(spark, folder):
    return adapters.users(spark, folder).select("user_id", text.mask_email(F.col("email")).alias("masked"))


@query
def sanitized_texts(spark, folder):
    """Texts cut to the column width."""
    return adapters.table(spark, folder, "conversations").select(
        "conv_id", "turn", text.sanitize(F.col("text")).alias("clean"))


@query
def data_audit(spark, folder):
    return audit.audit(_customers(spark, folder))
