"""Toxicity by class-conditional Kneser-Ney models.

Two unigram models, of toxic and of ordinary texts, are trained on labelled documents. As in Kneser-Ney smoothing a word
counts by the number of different contexts it is seen in; the context here is the document, equal texts once, so that neither
repetition in a text nor copies raise a count. Absolute discounts for counts of 1, 2 and 3 and more come from the counts of
counts, and the discounted mass goes to one backoff distribution that both classes share: a rare word has nearly the same
probability under either.

A text is compared by its length-normalised log-likelihood ratio, over all words and over the words on which the models clearly
disagree. A logistic curve fitted on labelled documents that the models haven't seen turns the comparison into a probability.

Labels are learnt from rows with crc32(doc_id as text) mod 4 other than 2; remainder 3 fits the curve, 0 and 1 the models. At most
about ``LABELLED`` labelled rows are used, chosen by a hash of the id. Words are runs of letters, A-Z lower-cased.

Null and empty texts get the score of a text without evidence. Null labels and labels other than 0 and 1 are left out, a
document labelled twice counts as toxic if either label says so. Without a label of each class every score is 0.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnlake.llm.tables import fold_of, free_name, kept_table, read_table
from churnlake.llm.text_arrays import NO_LETTER, slices, words

LABELLED = 40_000       # labelled rows used at most, about
FOLDS, HELD_OUT, CURVE = 4, 2, 3
THRESHOLD = 0.3
CLEAR = 2.0             # log ratio from which the models clearly disagree
LEAST_COUNT = 2         # rarer words count as unseen


class Model(NamedTuple):
    words: np.ndarray       # sorted hashes
    ratios: np.ndarray      # log P(word | toxic) - log P(word | ordinary)
    unseen: float
    curve: np.ndarray       # intercept and weights of the logistic curve


def _features(texts: pa.Array, model: Model) -> np.ndarray:
    """Mean log ratio, mean log ratio of clearly toxic words, and their log count, by text."""
    found = words(texts, NO_LETTER)
    n = np.diff(found.bounds)
    owner = np.repeat(np.arange(len(n)), n)
    ratio = np.full(len(found.hashes), model.unseen)
    if len(model.words):
        at = np.minimum(np.searchsorted(model.words, found.hashes), len(model.words) - 1)
        ratio = np.where(model.words[at] == found.hashes, model.ratios[at], model.unseen)
    clear = ratio > CLEAR
    size = np.maximum(n, 1)
    mean = np.bincount(owner, ratio, len(n)) / size
    strong = np.bincount(owner, np.where(clear, ratio, 0.0), len(n)) / size
    return np.column_stack([mean, strong, np.log1p(np.bincount(owner, clear, len(n)))])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _fit_curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    weights, ridge = np.zeros(x.shape[1]), np.diag([1e-6, *[1e-2] * (x.shape[1] - 1)])
    for _ in range(50):
        p = _sigmoid(x @ weights)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ weights)
        weights = weights + step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return weights


def _chosen(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, toxic and curve (boolean) of the labelled documents used: at most about LABELLED, equal texts once."""
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(
        F.max("toxic").alias("toxic")).where(fold_of(F.col("doc_id"), FOLDS) != HELD_OUT)
    share = min(1.0, LABELLED / max(1, marks.count()))
    marks = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    texts = docs.select("doc_id", F.xxhash64("text").alias("_text")).join(marks, "doc_id")
    first = texts.groupBy("_text", "toxic").agg(F.min("doc_id").alias("doc_id"))
    return first.select("doc_id", "toxic", (fold_of(F.col("doc_id"), FOLDS) == CURVE).alias("curve")).distinct()


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """The model, or None without labelled documents of both classes."""
    spark = docs.sparkSession
    chosen = kept_table(_chosen(docs, labels), "toxic-chosen")
    # bounded by LABELLED
    used = kept_table(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), "toxic-used")

    def contexts(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                found = words(batch.column("text"), NO_LETTER)
                n = np.diff(found.bounds)
                owner = np.repeat(np.arange(len(n)), n)
                pairs = np.unique(np.column_stack([owner.astype(np.uint64), found.hashes]), axis=0)
                toxic = np.asarray(batch.column("toxic"))[pairs[:, 0].astype(np.int64)]
                key, at = np.unique(pairs[:, 1], return_inverse=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(np.bincount(at, toxic == 0, len(key)).astype(np.int64)),
                     pa.array(np.bincount(at, toxic == 1, len(key)).astype(np.int64))], ["word", "ordinary", "toxic"])

    counts = used.where(~F.col("curve")).select("text", F.col("toxic").cast("long")).mapInArrow(
        contexts, "word long, ordinary long, toxic long")
    counts = kept_table(counts.groupBy("word").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic")),
                        "toxic-counts")
    sums = counts.agg(
        F.count(F.lit(1)).alias("types"),
        *[F.sum(F.when(F.col(c) == k, 1).otherwise(0)).alias(f"{c}_{k}") for c in ("ordinary", "toxic") for k in (1, 2, 3, 4)],
        *[F.sum(F.when(F.col(c) > 2, 1).otherwise(0)).alias(f"{c}_more") for c in ("ordinary", "toxic")],
        *[F.sum(c).alias(c) for c in ("ordinary", "toxic")]).first()
    if not sums["ordinary"] or not sums["toxic"]:
        return None
    rows = counts.where(F.col("ordinary") + F.col("toxic") >= LEAST_COUNT).toArrow().to_pandas()    # bounded by LABELLED texts
    everything = sums["ordinary"] + sums["toxic"]

    def shared(count):
        return (count + 0.5) / (everything + 0.5 * (sums["types"] + 1))

    def log_p(name):
        n = [sums[f"{name}_{k}"] for k in (1, 2, 3, 4)]
        y = n[0] / max(1, n[0] + 2 * n[1])
        cut = [0.0, *[min(k, max(0.1, k - (k + 1) * y * n[k] / max(1, n[k - 1]))) for k in (1, 2, 3)]]
        mass = (cut[1] * n[0] + cut[2] * n[1] + cut[3] * sums[f"{name}_more"]) / sums[name]
        return lambda c, total: np.log((c - np.array(cut)[np.minimum(c, 3)]) / sums[name] + mass * shared(total))

    toxic, ordinary = log_p("toxic"), log_p("ordinary")
    total = (rows["toxic"] + rows["ordinary"]).to_numpy()
    ratios = toxic(rows["toxic"].to_numpy(), total) - ordinary(rows["ordinary"].to_numpy(), total)
    zero = np.zeros(1, np.int64)
    hashes = rows["word"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    model = Model(hashes[order], ratios[order].astype(np.float32), float((toxic(zero, zero) - ordinary(zero, zero))[0]), np.zeros(4))
    shipped = spark.sparkContext.broadcast(model)

    def compare(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                x = _features(batch.column("text"), shipped.value)
                yield pa.RecordBatch.from_arrays([batch.column("toxic"), *map(pa.array, x.T)], ["toxic", "a", "b", "c"])

    seen = used.where("curve").select("text", F.col("toxic").cast("double")).mapInArrow(
        compare, "toxic double, a double, b double, c double").toArrow().to_pandas()            # bounded by LABELLED
    if seen["toxic"].nunique() < 2:
        return None
    return model._replace(curve=_fit_curve(seen[["a", "b", "c"]].to_numpy(), seen["toxic"].to_numpy()))


def scored(docs: DataFrame, model: Model | None, name: str = "score") -> DataFrame:
    """The documents with their score, computed from the whole text and nothing else."""
    if model is None:
        return docs.withColumn(name, F.lit(0.0))
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    columns = docs.columns
    at = columns.index("text")

    def run(batches):
        m = shipped.value
        for whole in batches:
            for batch in slices(whole, "text"):
                x = _features(batch.column(at), m)
                p = _sigmoid(np.column_stack([np.ones(len(x)), x]) @ m.curve)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], [*columns, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that aren't predicted toxic, with their own columns."""
    name = free_name(docs, "score")
    out = scored(docs, fit(docs, labels), name)
    return out.where(F.col(name) < THRESHOLD).select(*docs.columns)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, fit(docs, read_table(spark, sf_dir, "labels")))
    held = fold_of(F.col("doc_id"), FOLDS) == HELD_OUT
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
