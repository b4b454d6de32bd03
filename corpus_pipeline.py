"""The corpus pipeline: five stages over ``documents``, each written as Parquet and reread as the next one's input.

Quality rules and toxicity drop documents, line dedup cuts repeated runs out of texts (and drops texts of which nothing is left),
the n-gram join keeps one document of every group of near copies (five words, similarity 0.8), and packing places what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from churnlake.llm import line_dedup, ngram_join, packing, quality_rules, toxicity
from churnlake.llm.tables import read_table
from churnlake.session import finished


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, read_table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.keep_lines(docs, "n_chars" if "n_chars" in docs.columns else None)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality),
    ("toxicity", toxic),
    ("line_dedup", lines),
    ("ngram_jaccard_join", near_copies),
    ("best_fit_packing", packed),
]

#: SQL can't express the trained and the tokenising stages; the tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = finished(spark, f"stage-{name}", lambda: stage(spark, docs, sf_dir))
    return docs
