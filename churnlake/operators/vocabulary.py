"""Nominal columns as a vocabulary table, and sparse feature vectors put together from it.

The words of all columns are one table (position of the column, column, word, place): sorted by column and word, numbered by range, the first
word of a column without a place. Only the number of words of each column is known to the driver. A row finds its places by one left
join per column, broadcast if the column has no more than ``BROADCAST_WORDS`` words, else by a shuffle join that AQE may split; words that the
table lacks have no place. No plan and no metadata grows with the words.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructField, StructType

from churnlake.operators.ordering import with_row_number
from churnlake.session import staged

BROADCAST_WORDS = 20_000
WIDEST = 10_000                 # features that may become columns of their own
_TABLE = "position int, column string, word string, place long, scale double"
_VECTOR = StructType([StructField("v", VectorUDT())])


@dataclass
class Vocabulary:
    """Words of nominal columns. ``sizes`` counts the words with a place; ``scale`` of a word is 1 unless set."""

    table: DataFrame
    columns: list[str]
    sizes: list[int]

    @property
    def size(self) -> int:
        return sum(self.sizes)

    @classmethod
    def of(cls, words: DataFrame, columns: list[str]) -> "Vocabulary":
        """From rows (column, word): repeats meet before anything is sorted, nulls are no words."""
        position = F.array_position(F.array(*[F.lit(x) for x in columns]).cast("array<string>"), F.col("column")) - 1
        known = words.where(F.col("word").isNotNull() & F.col("column").isin(columns)).select(
            position.cast("int").alias("position"), "column", "word").distinct()
        numbered = with_row_number(known, [F.col("position"), F.col("word")], "n", start=0)
        counts = {r["position"]: (r["first"], r["n"]) for r in      # a row per column
                  numbered.groupBy("position").agg(F.min("n").alias("first"), F.count("*").alias("n")).collect()}
        sizes = [max(0, counts.get(j, (0, 0))[1] - 1) for j in range(len(columns))]
        first, before = F.lit(0).cast("long"), F.lit(0).cast("long")
        for j, (at, _) in counts.items():
            first = F.when(F.col("position") == j, at).otherwise(first)
            before = F.when(F.col("position") == j, sum(sizes[:j])).otherwise(before)
        place = F.when(F.col("n") > first, before + F.col("n") - first - 1)
        table = numbered.select("position", "column", "word", place.alias("place"), F.lit(1.0).alias("scale"))
        return cls(staged(table, "vocabulary"), list(columns), sizes)

    def scaled(self, counts: DataFrame, rows: int) -> "Vocabulary":
        """With the deviation of every word's 0/1 feature as its scale; ``counts`` has (column, word, n) of a table of ``rows`` rows."""
        share = F.coalesce(F.col("n"), F.lit(0)) / max(rows, 1)
        deviation = F.sqrt(share * (1 - share))
        table = self.table.drop("scale").join(counts.select("column", "word", "n"), ["column", "word"], "left").select(
            "position", "column", "word", "place", F.when(deviation > 0, deviation).otherwise(1.0).alias("scale"))
        return replace(self, table=staged(table, "vocabulary"))

    def located(self, df: DataFrame, words: dict[str, Column]) -> tuple[DataFrame, list[tuple[Column, Column]]]:
        """The rows with two more columns for each nominal column, and these as (place, 1 / scale), null without a place."""
        entries, added = [], []
        for j, column in enumerate(self.columns):
            if not self.sizes[j]:
                continue
            word, place, value = f"__word{j}", f"__place{j}", f"__value{j}"
            part = self.table.where((F.col("position") == j) & F.col("place").isNotNull()).select(
                F.col("word").alias(word), F.col("place").alias(place), (1 / F.col("scale")).alias(value))
            added.append((word, words[column], F.broadcast(part) if self.sizes[j] <= BROADCAST_WORDS else part))
            entries.append((F.col(place), F.col(value)))
        df = df.withColumns({word: text for word, text, _ in added})
        for word, _, part in added:
            df = df.join(part, word, "left").drop(word)
        return df, entries

    def names(self, before: int = 0) -> DataFrame:
        """Rows (place, name) of the features, places counted on from ``before``."""
        return self.table.where(F.col("place").isNotNull()).select(
            (F.col("place") + before).alias("place"), F.concat("column", F.lit("_"), "word").alias("name"))

    def save(self, path: str) -> None:
        spark = self.table.sparkSession
        self.table.write.mode("overwrite").parquet(f"{path}/words")
        text = json.dumps({"columns": self.columns, "sizes": self.sizes})
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/columns")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Vocabulary":
        saved = json.loads(spark.read.text(f"{path}/columns").first()["value"])
        return cls(spark.read.schema(_TABLE).parquet(f"{path}/words"), saved["columns"], saved["sizes"])


def sparse_vectors(df: DataFrame, size: int, entries: list[tuple[Column, Column]], passed: list[str], output: str = "features") -> DataFrame:
    """``passed`` and a sparse vector of the (place, value) entries, in ascending order of place; entries without place or value are 0.

    The vector type has no SQL constructor; JSON is the way to it that stays in the JVM.
    """
    given = F.array(*[F.struct(place.cast("int").alias("i"), value.cast("double").alias("x")) for place, value in entries]).cast("array<struct<i: int, x: double>>")
    pairs = df.select(*passed, F.filter(given, lambda e: e["i"].isNotNull() & (e["x"] != 0)).alias("__pairs"))
    vector = F.struct(F.struct(
        F.lit(0).cast("tinyint").alias("type"), F.lit(size).alias("size"), F.transform("__pairs", lambda e: e["i"]).alias("indices"),
        F.transform("__pairs", lambda e: e["x"]).alias("values")).alias("v"))
    return pairs.select(*passed, F.from_json(F.to_json(vector), _VECTOR)["v"].alias(output))


def name_table(spark: SparkSession, vocabulary: Vocabulary, before: list[str], after: list[str] = ()) -> DataFrame:
    """Rows (place, name) of all features: plain ones, words, plain ones."""
    start = len(before) + vocabulary.size
    plain = [*enumerate(before), *enumerate(after, start)]
    return spark.createDataFrame(plain, "place long, name string").unionByName(vocabulary.names(len(before)))


def names_of(table: DataFrame) -> list[str]:
    """The names in order of place, for whoever needs them on the driver."""
    return [r["name"] for r in table.orderBy("place").collect()]
