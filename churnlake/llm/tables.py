"""Reading the corpus tables and keeping intermediate tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlake.session import work_path, write_table

#: Code points between words; everything else belongs to a word.
WORD_GAP = r"[\x20\x09-\x0D]"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the given folder, by Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kept_table(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once below ``spark.checkpoint.dir`` and read back, so that every later reader sees the same rows
    and a lost executor costs a re-read and no recomputation. Inside a scope of ``session`` it is removed at the scope's end."""
    spark = df.sparkSession
    path = work_path(spark, f"llm-{name}")
    write_table(df, path)
    return spark.read.schema(df.schema).parquet(path)


def fold_of(doc_id, folds: int):
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def once(df: DataFrame, **columns) -> DataFrame:
    """Add columns that are computed exactly once per row: later filters and projections use the values instead of
    repeating the expressions."""
    fields = [column.alias(name) for name, column in columns.items()]
    return df.select("*", F.inline(F.array(F.struct(*fields))))


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or a longer name if the table already has such a column (compared without case)."""
    taken = {name.lower() for name in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted
