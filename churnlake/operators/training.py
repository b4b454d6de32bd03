"""Training, selection, saving and loading of the classifiers."""

from __future__ import annotations

import json
import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml.classification import (
    GBTClassificationModel, GBTClassifier, LogisticRegression, LogisticRegressionModel,
    RandomForestClassificationModel, RandomForestClassifier,
)
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from churnlake import config as c
from churnlake.functions.scoring import with_risk
from churnlake.operators.autoprep import auto_prepare
from churnlake.operators.cleaning import binary_encode, canonical_columns, clean_customers, with_defaults
from churnlake.operators.encoding import Encoder, fit_encoder, moments
from churnlake.operators.evaluation import evaluate
from churnlake.operators.splitting import stratified_split
from churnlake.operators.trees import fit_boosted, fit_forest, scores
from churnlake.operators.vocabulary import Vocabulary, name_table, names_of, sparse_vectors
from churnlake.session import spread

MODELS = ["logistic_regression", "random_forest", "boosted_trees"]
_LOADERS = {
    "logistic_regression": LogisticRegressionModel,
    "random_forest": RandomForestClassificationModel,
    "boosted_trees": GBTClassificationModel,
}


def estimators(rows: int, trees: int = 300, rounds: int = 300, balanced: bool = True, forest_depth: int = 12,
               boost_depth: int = 6, step: float = 0.05, subsample: float = 0.8, leaf: int = 4) -> dict:
    """The three classifiers; the boosted trees use every column in every tree. An L2 strength of 1 on the summed loss is 1/rows on Spark's mean loss."""
    weight = {"weightCol": "weight"} if balanced else {}
    return {
        "logistic_regression": LogisticRegression(
            maxIter=1000, regParam=1.0 / rows, elasticNetParam=0.0, standardization=False, **weight),
        "random_forest": RandomForestClassifier(
            numTrees=trees, maxDepth=forest_depth, minInstancesPerNode=leaf, featureSubsetStrategy="sqrt",
            seed=c.SEED, **weight),
        "boosted_trees": GBTClassifier(
            maxIter=rounds, maxDepth=boost_depth, stepSize=step, subsamplingRate=subsample, seed=c.SEED),
    }


@dataclass
class TrainingRun:
    """Fitted encoder and models, the held-out matrix and what is known about them."""

    encoder: Encoder | None
    models: dict
    best: str
    aucs: dict[str, float]
    seconds: dict[str, float]
    feature_count: int
    train: DataFrame
    test: DataFrame
    extra: dict = field(default_factory=dict)

    @property
    def best_model(self):
        return self.models[self.best]

    @property
    def features(self) -> list[str]:
        """Feature names in order, read from the encoder's table each time they are asked for."""
        return self.encoder.feature_names

    def release(self) -> None:
        self.train.unpersist()
        self.test.unpersist()

    def scored_test(self) -> DataFrame:
        """model, label and unrounded probability of the held-out rows."""
        frames = [scored(self.test, m, p="churn_probability").select(F.lit(name).alias("model"), "label", "churn_probability")
                  for name, m in self.models.items()]
        out = frames[0]
        for frame in frames[1:]:
            out = out.unionByName(frame)
        return out

    def metrics(self) -> DataFrame:
        """One row per model: metrics, AUC, sizes, churn rates, seconds, whether it won."""
        spark = self.test.sparkSession
        aucs = spark.createDataFrame([(n, a, self.seconds[n], n == self.best) for n, a in self.aucs.items()],
                                     "model string, roc_auc double, seconds double, best boolean")
        sizes = self.train.select("label", F.lit(1).alias("t")).unionByName(
            self.test.select("label", F.lit(0).alias("t"))).agg(
            F.count_if(F.col("t") == 1).alias("train_size"), F.count_if(F.col("t") == 0).alias("test_size"),
            F.avg(F.when(F.col("t") == 1, F.col("label"))).alias("churn_rate_train"),
            F.avg(F.when(F.col("t") == 0, F.col("label"))).alias("churn_rate_test")).withColumn("_one", F.lit(1))
        return (evaluate(self.scored_test(), by=["model"]).join(F.broadcast(aucs), "model")      # one row per model
                .withColumn("_one", F.lit(1)).join(F.broadcast(sizes), "_one").drop("_one")
                .withColumn("feature_count", F.lit(self.feature_count)))


def class_weights(df: DataFrame, label: str = "label") -> tuple[tuple[float, float], int]:
    """Rows / (2 x rows of the class) for classes 0 and 1, and the row count."""
    row = df.agg(F.count("*").alias("n"), F.count_if(F.col(label) == 1).alias("pos")).first()
    n, pos = row["n"], row["pos"]
    if pos in (0, n):
        raise ValueError("both classes are needed to train")
    return (n / (2.0 * (n - pos)), n / (2.0 * pos)), n


def with_class_weight(df: DataFrame, label: str = "label") -> tuple[DataFrame, int]:
    """Weight rows / (2 x rows of the class), and the row count."""
    (zero, one), n = class_weights(df, label)
    return df.withColumn("weight", F.when(F.col(label) == 1, one).otherwise(zero)), n


def fit_in_blocks(estimator, weighted: DataFrame, rows: int, weights: tuple[float, float]):
    """Fit the trees by passes over packed blocks, any other estimator as it is."""
    data = weighted.select("features", "label")
    if isinstance(estimator, GBTClassifier):
        return fit_boosted(data, rows, estimator)
    if isinstance(estimator, RandomForestClassifier):
        return fit_forest(data, rows, estimator, weights if estimator.isSet("weightCol") else (1.0, 1.0), float(rows))
    return estimator.fit(weighted)


def scored(df: DataFrame, model, raw: str = "_raw", p: str = "_p1") -> DataFrame:
    """Append the raw prediction and the probability of class 1 of a frame with features."""
    if isinstance(model, (GBTClassificationModel, RandomForestClassificationModel)):
        margin, chance = scores(model)
        return df.withColumns({raw: margin, p: chance})
    return model.transform(df).select(*df.columns, vector_to_array("rawPrediction")[1].alias(raw), vector_to_array("probability")[1].alias(p))


def train_all(train: DataFrame, test: DataFrame, models: list[str] | None = None, blocks: bool = False,
              **sizes) -> tuple[dict, dict, dict, str]:
    """Fit each model, measure the AUC on the test rows; the first of the best wins. ``blocks``: trees by passes over packed blocks,
    for features of which a byte a row fits into the tasks."""
    weights, rows = class_weights(train)
    weighted = train.withColumn("weight", F.when(F.col("label") == 1, weights[1]).otherwise(weights[0]))
    judge = BinaryClassificationEvaluator(rawPredictionCol="_raw", metricName="areaUnderROC", numBins=0)
    wanted = {name: x for name, x in estimators(rows, **sizes).items() if not models or name in models}

    def fit(name: str):
        begin = time.perf_counter()
        estimator = wanted[name].setFeaturesCol("features").setLabelCol("label")
        model = fit_in_blocks(estimator, weighted, rows, weights) if blocks else estimator.fit(weighted)
        return model, time.perf_counter() - begin

    with ThreadPoolExecutor(len(wanted)) as pool:       # the fits don't depend on each other
        found = dict(zip(wanted, pool.map(fit, wanted)))
    fitted, seconds = {n: m for n, (m, _) in found.items()}, {n: s for n, (_, s) in found.items()}
    aucs = {name: round(judge.evaluate(scored(test, model)), 6) for name, model in fitted.items()}
    best = max(aucs, key=lambda name: aucs[name])
    return fitted, seconds, aucs, best


def model_input(df: DataFrame, charges_median: float | None = None, drop_duplicates: bool = False) -> DataFrame:
    """Canonical, defaulted, cleaned and binary-encoded columns."""
    return binary_encode(clean_customers(with_defaults(canonical_columns(df)), drop_duplicates, charges_median))


def train_customers(df: DataFrame, models: list[str] | None = None, **sizes) -> TrainingRun:
    """Clean, split, fit the encoder on the training part only, train, select."""
    ready = model_input(df, drop_duplicates=True).persist(StorageLevel.MEMORY_AND_DISK)
    split = stratified_split(ready)
    encoder = fit_encoder(split.where(F.col("split") == "train").drop("split"))
    matrix = encoder.matrix(spread(split, ready.count()), keep=[c.ID, c.TARGET, "split"]).withColumn("label", F.col(c.TARGET).cast("double"))
    train = matrix.where(F.col("split") == "train").select("features", "label").persist(StorageLevel.MEMORY_AND_DISK)
    test = matrix.where(F.col("split") == "test").select("features", "label").persist(StorageLevel.MEMORY_AND_DISK)
    train.count(), test.count()
    ready.unpersist()
    fitted, seconds, aucs, best = train_all(train, test, models, blocks=True, **sizes)
    return TrainingRun(encoder, fitted, best, aucs, seconds, encoder.feature_count, train, test)


def probability(df: DataFrame, encoder: Encoder, model, output: str = "_p", features: str | None = None) -> DataFrame:
    """Append the unrounded churn probability; every input row and column stays. ``features`` names a column that keeps the vector."""
    packed = df.withColumn("_row", F.struct("*"))
    matrix = encoder.matrix(model_input(packed, encoder.medians.get("TotalCharges", 0.0)), keep=["_row"])
    vector = [F.col("features").alias(features)] if features else []
    return scored(matrix, model).select("_row.*", F.col("_p1").alias(output), *vector)


def score_batch(df: DataFrame, encoder: Encoder, model, threshold: float = c.CHURN_THRESHOLD, features: str | None = None) -> DataFrame:
    """Append probability (4 places), label, score and category; derived from the unrounded value."""
    return with_risk(probability(df, encoder, model, features=features), F.col("_p"), threshold).drop("_p")


def raw_probabilities(df: DataFrame, encoder: Encoder, model) -> DataFrame:
    """Append both class probabilities as they come from the model."""
    return probability(df, encoder, model, "p1").withColumn("p0", 1 - F.col("p1"))


def scorer(encoder: Encoder, model):
    """The model as a frame-to-frame scorer, for the scenario operators."""
    return lambda df: score_batch(df, encoder, model)


# -- custom tables ---------------------------------------------------------------------------------
@dataclass
class CustomModel:
    """Model of an arbitrary labelled table. Features are divided by their deviations and not centred, which changes neither trees nor a
    linear model with a free intercept, and keeps words sparse. Plain features are few and known by name; the scales of word
    features are in the vocabulary."""

    name: str
    model: object
    kind: str
    deviations: dict[str, float]        # plain features in order
    vocabulary: Vocabulary
    meta: dict

    @property
    def feature_count(self) -> int:
        return len(self.deviations) + self.vocabulary.size

    def feature_table(self) -> DataFrame:
        """Rows (place, name)."""
        return name_table(self.vocabulary.table.sparkSession, self.vocabulary, list(self.deviations))

    @property
    def features(self) -> list[str]:
        """All names on the driver: read from the table each time they are asked for."""
        return names_of(self.feature_table())

    def _plain(self, present: list[str]) -> list[tuple[Column, Column]]:
        def number(x: str) -> Column:
            value = F.col(f"`{x}`").cast("string").try_cast("double")
            return F.when(~F.isnan(value), value) / (self.deviations[x] or 1.0)
        return [(F.lit(i), number(x)) for i, x in enumerate(self.deviations) if x in present]

    def prepared_vectors(self, data: DataFrame, keep: list[str]) -> DataFrame:
        """Scaled vectors of a prepared table: its words are looked up."""
        narrow = data.select("*", *[F.col(f"`{x}`").alias(f"__c{j}") for j, x in enumerate(self.vocabulary.columns)])
        found, entries = self.vocabulary.located(narrow, {x: F.col(f"__c{j}") for j, x in enumerate(self.vocabulary.columns)})
        first = len(self.deviations)
        words = [(place + first, value) for place, value in entries]
        return sparse_vectors(found, self.feature_count, [*self._plain(data.columns), *words], keep)

    def vectors(self, df: DataFrame, keep: list[str]) -> DataFrame:
        """Scaled vectors of a table whose columns are features; a feature that is absent or unreadable counts as 0. Only names of
        the table's own columns are looked for among the words."""
        first = len(self.deviations)
        own = self.vocabulary.names(first).join(self.vocabulary.table.select((F.col("place") + first).alias("place"), "scale"), "place").where(
            F.col("name").isin(df.columns)).orderBy("place").collect()
        words = [(F.lit(r["place"]), F.col(f"`{r['name']}`").cast("string").try_cast("double") / r["scale"]) for r in own]
        words = [(place, F.when(~F.isnan(value), value)) for place, value in words]
        return sparse_vectors(df, self.feature_count, [*self._plain(df.columns), *words], keep)


def train_custom(df: DataFrame, key: list[str] | None = None, hint: str = "churn", industry: str = "general",
                 name: str | None = None, ratio: float = c.ID_LIKE_RATIO, models: list[str] | None = None,
                 **sizes) -> CustomModel:
    """Prepare, split, scale, train three default models, keep the best by AUC.

    ``key`` names the columns the split hashes; without it the whole row is hashed.
    """
    keep = key or []
    ready = auto_prepare(df, hint, ratio, keep)
    split = stratified_split(ready.data, ready.target, key or ready.data.columns)
    train = split.where(F.col("split") == "train")
    _, deviations = moments(train, {x: 0.0 for x in ready.plain}) if ready.plain else ({}, {})
    words = ready.vocabulary.scaled(ready.word_counts(train), train.count())
    custom = CustomModel(name or industry, None, "", deviations, words, {})
    labelled = split.withColumn("label", F.col(ready.target).cast("double"))
    matrix = custom.prepared_vectors(spread(labelled, labelled.count()), ["label", "split"])
    parts = {x: matrix.where(F.col("split") == x).select("features", "label").persist(StorageLevel.MEMORY_AND_DISK)
             for x in ("train", "test")}
    options = {"trees": 100, "rounds": 100, "balanced": False, "forest_depth": 15, "boost_depth": 3, "step": 0.1,
               "subsample": 1.0, "leaf": 1} | sizes
    fitted, _, aucs, best = train_all(parts["train"], parts["test"], models, **options)
    run = TrainingRun(None, fitted, best, aucs, {n: 0.0 for n in fitted}, custom.feature_count, parts["train"], parts["test"])
    rows = evaluate(run.scored_test(), by=["model"]).collect()
    overall = ready.data.agg(F.count("*").alias("n"), F.avg(ready.target).alias("rate")).first()
    run.release()
    custom.model, custom.kind = fitted[best], best
    custom.meta = {
        "industry": industry, "model_name": custom.name, "best_model": best, "best_auc": round(aucs[best], 4),
        "target_column": ready.target, "n_samples": overall["n"], "n_features": custom.feature_count, "churn_rate": round(overall["rate"], 4),
        "model_results": {r["model"]: {"accuracy": r["accuracy"], "f1": r["f1"], "roc_auc": round(aucs[r["model"]], 4)}
                          for r in rows},
    }
    return custom


# -- artefacts -------------------------------------------------------------------------------------
def _write_json(spark: SparkSession, content: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(content),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def _read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()["value"])


def save_run(run: TrainingRun, path: str) -> None:
    """Every model, the encoder, the feature names, the train and test matrices, and the metadata: best model, sizes, churn rates,
    evaluations."""
    spark = run.test.sparkSession
    run.encoder.feature_table().write.mode("overwrite").parquet(f"{path}/features")
    run.train.write.mode("overwrite").parquet(f"{path}/train")
    run.test.write.mode("overwrite").parquet(f"{path}/test")
    for name, model in run.models.items():
        model.write().overwrite().save(f"{path}/{name}")
    run.encoder.save(spark, f"{path}/encoder")
    rows = [r.asDict() for r in run.metrics().collect()]        # one per model
    shared = ("feature_count", "train_size", "test_size", "churn_rate_train", "churn_rate_test")
    meta = {"best_model": run.best, "auc_scores": run.aucs, "seconds": run.seconds,
            **{x: rows[0][x] for x in shared},
            "evaluations": {r["model"]: {k: v for k, v in r.items() if k not in (*shared, "model")} for r in rows}}
    _write_json(spark, meta, f"{path}/metadata")


def load_run(spark: SparkSession, path: str) -> TrainingRun:
    """A saved run with all its models."""
    meta = _read_json(spark, f"{path}/metadata")
    models = {name: _LOADERS[name].load(f"{path}/{name}") for name in meta["auc_scores"]}
    return TrainingRun(Encoder.load(spark, f"{path}/encoder"), models, meta["best_model"], meta["auc_scores"], meta["seconds"],
                       meta["feature_count"], spark.read.parquet(f"{path}/train"), spark.read.parquet(f"{path}/test"))


def load_model(spark: SparkSession, path: str, name: str | None = None) -> tuple[Encoder, object, dict]:
    """Encoder, the named (or best) model, and the metadata."""
    meta = _read_json(spark, f"{path}/metadata")
    name = name or meta["best_model"]
    return Encoder.load(spark, f"{path}/encoder"), _LOADERS[name].load(f"{path}/{name}"), meta


def save_custom(custom: CustomModel, spark: SparkSession, path: str) -> None:
    """Model, vocabulary and the table of feature names; the metadata holds numbers of the plain features only."""
    custom.model.write().overwrite().save(f"{path}/model")
    custom.vocabulary.save(f"{path}/vocabulary")
    custom.feature_table().write.mode("overwrite").parquet(f"{path}/features")
    _write_json(spark, {"kind": custom.kind, "name": custom.name, "deviations": custom.deviations, "meta": custom.meta}, f"{path}/metadata")


def load_custom(spark: SparkSession, path: str) -> CustomModel:
    saved = _read_json(spark, f"{path}/metadata")
    model = _LOADERS[saved["kind"]].load(f"{path}/model")
    return CustomModel(saved["name"], model, saved["kind"], saved["deviations"], Vocabulary.load(spark, f"{path}/vocabulary"), saved["meta"])
