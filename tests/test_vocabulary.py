"""Vocabulary tables: places, skew, a million words, features of any labelled table."""

import random

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from churnlake.operators import autoprep, encoding, training, vocabulary
from churnlake.operators.encoding import Encoder
from churnlake.operators.vocabulary import Vocabulary
from churnlake.session import work_path


@pytest.mark.parametrize("broadcast_words", [0, 20_000])
def test_places_and_unseen_words(spark, monkeypatch, broadcast_words):
    """Broadcast or shuffled, a row finds the same places; first, unseen and null words have none."""
    monkeypatch.setattr(vocabulary, "BROADCAST_WORDS", broadcast_words)
    words = [("b", x) for x in ("z", "é", "a", "Z")] + [("a", x) for x in ("2", "10", "1")] + [("b", "a"), ("b", None), ("empty", None)]
    found = Vocabulary.of(spark.createDataFrame(words, "column string, word string"), ["a", "empty", "b"])
    assert found.sizes == [2, 0, 3]
    assert [(r.place, r.name) for r in found.names(5).orderBy("place").collect()] == [
        (5, "a_10"), (6, "a_2"), (7, "b_a"), (8, "b_z"), (9, "b_é")]
    rows = [(0, "2", "z"), (1, "1", "Z"), (2, None, "é"), (3, "new", None), (4, "10", "a")] + [(5 + i, "2", "z") for i in range(500)]
    df = spark.createDataFrame(rows, "i long, a string, b string").withColumn("empty", F.lit("x"))
    located, entries = found.located(df, {x: F.col(x) for x in ("a", "b", "empty")})
    vectors = vocabulary.sparse_vectors(located, 5, entries, ["i"])
    got = {r.i: r.features.toArray().tolist() for r in vectors.collect()}
    assert len(got) == 505
    assert [got[i] for i in range(5)] == [[0, 1, 0, 1, 0], [0, 0, 0, 0, 0], [0, 0, 0, 0, 1], [0, 0, 0, 0, 0], [1, 0, 1, 0, 0]]
    assert all(got[i] == got[0] for i in range(5, 505))


def test_million_words(spark, monkeypatch):
    """A column of a million words encodes; the driver gets no word, and the plan does not grow."""
    df = spark.range(1_000_000).select(F.concat(F.lit("w"), F.lpad(F.col("id").cast("string"), 7, "0")).alias("Contract"),
                                       (F.col("id") % 10).cast("double").alias("tenure"))
    monkeypatch.setattr(Encoder, "feature_names", property(lambda self: pytest.fail("names were collected")))
    encoder = encoding.fit_encoder(df)
    assert encoder.feature_count == 1_000_000
    matrix = encoder.matrix(df)
    plan = matrix._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 20_000 and "w0000" not in plan
    last = matrix.where("Contract = 'w0999999'").first().features
    assert last.size == 1_000_000 and last[999_999] == 1.0
    nonzero = matrix.select(F.size(F.filter(vector_to_array(F.col("features")), lambda x: x == 1.0)).alias("n")).limit(20).collect()
    assert all(r.n <= 1 for r in nonzero)
    path = work_path(spark, "test-encoder")
    encoder.save(spark, path)
    assert Encoder.load(spark, path).matrix(df.limit(1)).first().features.size == 1_000_000
    with pytest.raises(ValueError):
        encoder.feature_columns()


def test_matrix_equals_columns(spark, customers):
    ready = training.model_input(customers, drop_duplicates=True)
    encoder = encoding.fit_encoder(ready)
    names = encoder.feature_names
    wide = ready.select("customerID", *[x.alias(f"f{i}") for i, x in enumerate(encoder.feature_columns().values())])
    expected = {r.customerID: [r[f"f{i}"] for i in range(len(names))] for r in wide.collect()}
    got = {r.customerID: r.features.toArray() for r in encoder.matrix(ready, keep=["customerID"]).collect()}
    assert got.keys() == expected.keys() and all(np.allclose(got[k], expected[k], atol=1e-15) for k in got)


def _labelled(spark, words: int, rows: int):
    rng = random.Random(1)
    data = []
    for i in range(rows):
        w = rng.randrange(words)
        data.append((i, f"w{w:05d}" if i % 50 else None, float(rng.randrange(5)), rng.random() < 0.5, "yes" if (w % 2 == 0) != (rng.random() < 0.1) else "no"))
    return spark.createDataFrame(data, "id long, word string, x double, flag boolean, churn string")


def test_wide_column_trains(spark):
    """Ten thousand words are features of a model whose plans have one expression a column."""
    df = _labelled(spark, 10_000, 22_000)
    ready = autoprep.auto_prepare(df, keep=["id"], ratio=0.95)
    assert ready.plain == ["x", "flag"] and 8_000 < ready.feature_count <= 10_001
    custom = training.train_custom(df, ["id"], models=["logistic_regression"])
    plan = custom.prepared_vectors(ready.data, ["id"])._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 20_000 and custom.meta["n_features"] == ready.feature_count
    assert custom.meta["best_auc"] > 0.6                 # two rows a word or so teach what half of the words mean


def test_custom_vectors_and_scales(spark):
    df = _labelled(spark, 6, 400)
    custom = training.train_custom(df, ["id"], models=["logistic_regression"])
    names = custom.features
    assert names == ["x", "flag", *[f"word_w{i:05d}" for i in range(1, 6)]]
    # by hand: deviations of the training rows, not centred
    ready = autoprep.auto_prepare(df, keep=["id"])
    split = training.stratified_split(ready.data, ready.target, ["id"]).toPandas()
    train = split[split.split == "train"]
    columns = {"x": train.x, "flag": train.flag, **{f"word_w{i:05d}": (train.word == f"w{i:05d}") * 1.0 for i in range(1, 6)}}
    scale = {n: np.std(v) for n, v in columns.items()}
    row = custom.prepared_vectors(ready.data.where("id = 7"), ["id"]).first()
    mine = split[split.id == 7].iloc[0]
    expected = [mine.x / scale["x"], mine.flag / scale["flag"], *[(mine.word == n[5:]) / scale[n] for n in names[2:]]]
    assert row.features.toArray().tolist() == pytest.approx(expected)
    # a table to be scored may have feature columns, unreadable cells and no others
    score = spark.createDataFrame([("2.0", 1, "odd")], "x string, word_w00003 int, flag string")
    assert custom.vectors(score.select(F.lit("z").alias("other")), ["other"]).first().features.numNonzeros() == 0
    got = custom.vectors(score, ["x"]).first().features.toArray().tolist()
    assert got == pytest.approx([2 / scale["x"], 0, 0, 0, 1 / scale["word_w00003"], 0, 0])
    path = work_path(spark, "test-custom-words")
    training.save_custom(custom, spark, path)
    again = training.load_custom(spark, path)
    assert again.features == names and again.vectors(score, ["x"]).first().features == custom.vectors(score, ["x"]).first().features


def test_totals_of_odd_tables(spark):
    """Text without any value, no text at all, no rows of a word in the table."""
    df = spark.createDataFrame([(1.0, None, 1), (2.0, None, 0), (2.0, None, 0)], "x double, note string, churn int")
    ready = autoprep.auto_prepare(df)
    assert ready.features == ["x"]              # the only word, "unknown", is the one without a place
    assert {r.feature: r.total for r in autoprep.feature_totals(ready).collect()} == {"x": 5.0, "churn": 1.0}
    plain = autoprep.auto_prepare(df.drop("note"))
    assert plain.features == ["x"] and autoprep.feature_totals(plain).count() == 2
