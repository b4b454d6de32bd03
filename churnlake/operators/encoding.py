"""Learned numeric and one-hot encoding, and the feature matrix."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from churnlake import config as c
from churnlake.functions.scoring import lookup
from churnlake.operators.ordering import collect_quantiles, value_counts
from churnlake.operators.vocabulary import WIDEST, Vocabulary, name_table, names_of, sparse_vectors

_MISSING = "Missing"


def _word(x: str) -> Column:
    return F.coalesce(F.col(x).cast("string"), F.lit(_MISSING))


@dataclass
class Encoder:
    """Fitted statistics: a few numbers per numeric column, and a table of the words of the nominal ones."""

    medians: dict[str, float]
    means: dict[str, float]
    deviations: dict[str, float]
    vocabulary: Vocabulary
    binary: list[str]

    @property
    def feature_count(self) -> int:
        return len(self.medians) + self.vocabulary.size + len(self.binary)

    def feature_table(self) -> DataFrame:
        """Rows (place, name): numeric columns, words, flags."""
        return name_table(self.vocabulary.table.sparkSession, self.vocabulary, list(self.medians), self.binary)

    @property
    def feature_names(self) -> list[str]:
        """All names on the driver: read from the table each time they are asked for."""
        return names_of(self.feature_table())

    def _plain(self) -> tuple[dict[str, Column], dict[str, Column]]:
        """Numeric and binary features by name."""
        numeric = {x: (F.coalesce(F.col(x).cast("double"), F.lit(median)) - self.means[x]) / (self.deviations[x] or 1.0)
                   for x, median in self.medians.items()}
        return numeric, {x: F.col(x).cast("double") for x in self.binary}

    def feature_columns(self) -> dict[str, Column]:
        """A column for each feature, for tables with few words."""
        if self.feature_count > WIDEST:
            raise ValueError(f"{self.feature_count} features are too many for columns of their own; use matrix()")
        numeric, flags = self._plain()
        words = self.vocabulary.table.where(F.col("place").isNotNull()).orderBy("place").collect()
        dummies = {f"{r['column']}_{r['word']}": F.when(_word(r["column"]) == r["word"], 1.0).otherwise(0.0) for r in words}
        return numeric | dummies | flags

    def matrix(self, df: DataFrame, output: str = "features", keep: list[str] | None = None) -> DataFrame:
        """Append the sparse feature vector; ``keep`` limits the pass-through columns."""
        passed = df.columns if keep is None else keep
        numeric, flags = self._plain()
        plain = {**{f"__n{i}": x for i, x in enumerate(numeric.values())}, **{f"__b{i}": x for i, x in enumerate(flags.values())}}
        narrow = df.select(*passed, *[x.alias(n) for n, x in plain.items()],
                           *[_word(x).alias(f"__c{j}") for j, x in enumerate(self.vocabulary.columns)])
        found, entries = self.vocabulary.located(narrow, {x: F.col(f"__c{j}") for j, x in enumerate(self.vocabulary.columns)})
        first, last = len(numeric), len(numeric) + self.vocabulary.size
        entries = [*[(F.lit(i), F.col(f"__n{i}")) for i in range(first)], *[(place + first, value) for place, value in entries],
                   *[(F.lit(last + i), F.col(f"__b{i}")) for i in range(len(flags))]]
        return sparse_vectors(found, self.feature_count, entries, passed, output)

    def save(self, spark: SparkSession, path: str) -> None:
        text = json.dumps({"medians": self.medians, "means": self.means, "deviations": self.deviations, "binary": self.binary})
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/statistics")
        self.vocabulary.save(f"{path}/vocabulary")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Encoder":
        saved = json.loads(spark.read.text(f"{path}/statistics").first()["value"])
        return cls(saved["medians"], saved["means"], saved["deviations"], Vocabulary.load(spark, f"{path}/vocabulary"), saved["binary"])


def moments(df: DataFrame, medians: dict[str, float | None]) -> tuple[dict, dict]:
    """Mean and population deviation of the median-filled columns, one aggregate."""
    columns = list(medians)
    filled = df.select(*[F.coalesce(F.col(x).cast("double"), F.lit(medians[x] or 0.0)).alias(x) for x in columns])
    row = filled.agg(*[F.avg(x).alias(f"m{i}") for i, x in enumerate(columns)],
                     *[F.stddev_pop(x).alias(f"s{i}") for i, x in enumerate(columns)]).first()
    return ({x: row[f"m{i}"] for i, x in enumerate(columns)}, {x: row[f"s{i}"] for i, x in enumerate(columns)})


def _moments_of_counts(counts: DataFrame, medians: dict[str, float]) -> tuple[dict, dict]:
    """The same from value counts: a mean, then the mean squared distance from it."""
    rows = counts.where(F.col("metric").isin(list(medians)))
    value = F.coalesce("value", lookup(F.col("metric"), medians, 0.0))

    def mean(x: Column) -> dict[str, float]:
        weighed = rows.groupBy("metric").agg((F.sum(x * F.col("n")) / F.sum("n")).alias("m")).collect()
        return {r["metric"]: r["m"] for r in weighed}
    means = mean(value)
    squares = mean(F.pow(value - lookup(F.col("metric"), means, 0.0), F.lit(2)))
    return {x: means[x] for x in medians}, {x: squares[x] ** 0.5 for x in medians}


def fit_encoder(df: DataFrame) -> Encoder:
    """Fit on a cleaned, binary-encoded frame; only columns that are present take part.

    One scan: medians, moments and the vocabulary all come from the table of distinct values.
    """
    numeric = [x for x in c.NUMERIC if x in df.columns]
    nominal = [x for x in c.NOMINAL if x in df.columns]
    counts = value_counts(df, numeric, nominal)
    medians = {x: v or 0.0 for x, v in collect_quantiles(counts, numeric).items()}
    means, deviations = _moments_of_counts(counts, medians)
    words = counts.where(F.col("metric").isin(nominal)).select(
        F.col("metric").alias("column"), F.coalesce("word", F.lit(_MISSING)).alias("word"))
    return Encoder(medians, means, deviations, Vocabulary.of(words, nominal), [x for x in c.BINARY if x in df.columns])
