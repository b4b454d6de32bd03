"""Automatic preparation of any labelled table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BooleanType

from churnlake import config as c
from churnlake.operators.cleaning import is_number
from churnlake.functions.scoring import lookup
from churnlake.operators.ordering import collect_quantiles, value_counts
from churnlake.operators.vocabulary import Vocabulary, name_table, names_of


@dataclass
class PreparedTable:
    """``data`` has the numeric and flag columns as numbers, the text columns filled, and the 0/1 target. The features are the plain
    columns and a 0/1 feature for each word of the vocabulary that has a place."""

    data: DataFrame
    plain: list[str]
    vocabulary: Vocabulary
    target: str
    dropped: list[str]

    @property
    def feature_count(self) -> int:
        return len(self.plain) + self.vocabulary.size

    def feature_table(self) -> DataFrame:
        """Rows (place, name)."""
        return name_table(self.data.sparkSession, self.vocabulary, self.plain)

    @property
    def features(self) -> list[str]:
        """All names on the driver: read from the table each time they are asked for."""
        return names_of(self.feature_table())

    def word_counts(self, rows: DataFrame | None = None) -> DataFrame:
        """Rows (column, word, n) over ``data`` or some of its rows."""
        return word_counts(self.data if rows is None else rows, self.vocabulary.columns)


def find_target(columns: list[str], hint: str = "churn") -> str:
    """Exact name, then a name containing the hint, then a common name; case never matters."""
    lowered = {name: name.lower() for name in columns}
    wanted = hint.lower()
    tests = [lambda low: low == wanted, lambda low: wanted in low]
    tests += [lambda low, common=common: low == common for common in c.TARGET_NAMES]
    for test in tests:
        for name, low in lowered.items():
            if test(low):
                return name
    raise ValueError(f"no target column like '{hint}' among {columns}")


def target_flag(df: DataFrame, target: str) -> Column:
    if isinstance(df.schema[target].dataType, BooleanType) or is_number(df, target):
        return F.coalesce(F.col(target).try_cast("int"), F.lit(0))
    return F.coalesce(F.lower(target).isin(c.POSITIVE_TOKENS).cast("int"), F.lit(0))


def id_like_columns(df: DataFrame, columns: list[str], ratio: float = c.ID_LIKE_RATIO) -> list[str]:
    """Columns with more distinct values than ``ratio`` of the rows.

    All are counted exactly, from one table of distinct cells.
    """
    if not columns:
        return []
    rows = df.count()
    cells = F.explode(F.array(*[F.struct(F.lit(x).alias("name"), F.col(f"`{x}`").cast("string").alias("cell")) for x in columns]))
    distinct = df.select(cells.alias("c")).select("c.*").where(F.col("cell").isNotNull()).distinct()
    counts = {r["name"]: r["count"] for r in distinct.groupBy("name").count().collect()}
    return [x for x in columns if rows and counts.get(x, 0) / rows > ratio]


def smallest_modes(counts: DataFrame) -> dict[str, str]:
    """Most frequent word per column of a value-count table, the smallest on a tie."""
    words = counts.where(F.col("word").isNotNull())
    best = words.groupBy("metric").agg(F.min(F.struct(-F.col("n"), "word"))["word"].alias("word")).collect()
    return {r["metric"]: r["word"] for r in best}


def word_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (column, word, n) of text columns; repeats meet in the map-side aggregate."""
    cells = F.array(*[F.struct(F.lit(x).alias("column"), F.col(f"`{x}`").alias("word")) for x in columns]) if columns else \
        F.array().cast("array<struct<column: string, word: string>>")
    return df.select(F.inline(cells)).groupBy("column", "word").agg(F.count("*").alias("n"))


def feature_totals(ready: PreparedTable) -> DataFrame:
    """Rows and total of every prepared feature and of the target, words as rows of a table all the way."""
    plain = [*ready.plain, ready.target]
    cells = F.array(*[F.struct(F.lit(x).alias("feature"), F.col(f"`{x}`").cast("double").alias("value")) for x in plain])
    numbers = ready.data.select(F.inline(cells)).groupBy("feature").agg(F.count("*").alias("rows"), F.sum("value").alias("total"))
    counts = ready.word_counts()
    rows = counts.groupBy("column").agg(F.sum("n").alias("rows"))       # every row has a word in every text column
    words = ready.vocabulary.table.where(F.col("place").isNotNull()).join(counts, ["column", "word"], "left").join(rows, "column").select(
        F.concat("column", F.lit("_"), "word").alias("feature"), "rows", F.coalesce("n", F.lit(0)).cast("double").alias("total"))
    return numbers.unionByName(words)


def auto_prepare(df: DataFrame, hint: str = "churn", ratio: float = c.ID_LIKE_RATIO, keep: list[str] = ()) -> PreparedTable:
    """0/1 target, ID-like columns dropped, medians and modes filled, a vocabulary of the text columns.

    ``keep`` names key columns to carry along outside the features.
    """
    target = find_target([x for x in df.columns if x not in keep], hint)
    candidates = [x for x in df.columns if x != target and x not in keep]
    dropped = id_like_columns(df, candidates, ratio)
    used = [x for x in candidates if x not in dropped]
    numeric = [x for x in used if is_number(df, x)]
    flags = [x for x in used if isinstance(df.schema[x].dataType, BooleanType)]
    text = [x for x in used if x not in numeric and x not in flags]

    counts = value_counts(df, numeric, [*text, *flags])
    medians = collect_quantiles(counts, numeric) if numeric else {}
    modes = smallest_modes(counts) if text or flags else {}
    filled = df.withColumns({
        **{x: F.coalesce(F.col(x).cast("double"), F.lit(medians[x]).cast("double"), F.lit(0.0)) for x in numeric},
        **{x: F.coalesce(F.col(x).cast("string"), F.lit(modes.get(x, "unknown"))) for x in [*text, *flags]},
    })
    columns = {x: F.col(f"`{x}`") for x in numeric} | {x: (F.col(f"`{x}`") == "true").cast("double") for x in flags}
    data = filled.select(*keep, *[col.alias(name) for name, col in columns.items()], *[F.col(f"`{x}`") for x in text],
                         target_flag(df, target).alias(target))
    # after filling, the counted words and each column's mode are all there are
    words = counts.where(F.col("metric").isin(text)).select(
        F.col("metric").alias("column"), (F.coalesce("word", lookup(F.col("metric"), modes, "unknown")) if modes else F.lit("unknown")).alias("word"))
    modal = df.sparkSession.createDataFrame([(x, modes.get(x, "unknown")) for x in text], "column string, word string")
    return PreparedTable(data, list(columns), Vocabulary.of(words.unionByName(modal), text), target, dropped)
