"""File sources and sinks: customer CSV, scoring CSV, training CSV, operational tables, reports."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from churnlake import config as c, schemas

_KNOWN_TYPES = {f.name: f.dataType for f in schemas.CUSTOMER if f.name != "TotalCharges"}
_KNOWN_TYPES |= {snake: _KNOWN_TYPES[name] for snake, name in c.CANONICAL_NAMES.items() if name in _KNOWN_TYPES}
_KNOWN_TYPES[c.ID] = StringType()


def _csv_columns(spark: SparkSession, path: str, **options) -> list[str]:
    """Column names of a CSV: reads the header only."""
    try:
        return spark.read.options(header=True, **options).csv(path).columns
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(path) from error
        raise


def _csv(spark: SparkSession, path: str, schema: StructType, **options) -> DataFrame:
    return spark.read.options(header=True, **options).schema(schema).csv(path)


def read_raw_customers(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, so that cleaning decides every type."""
    names = _csv_columns(spark, path)
    return _csv(spark, path, StructType([StructField(x, StringType()) for x in names]))


def _typed(name: str) -> Column:
    """A text column in its known type; numbers are read as doubles first, so that 3.0 is a whole number too."""
    kind = _KNOWN_TYPES.get(name, StringType())
    if isinstance(kind, StringType):
        return F.col(f"`{name}`")
    value = F.trim(f"`{name}`").try_cast("double")
    return F.when(~F.isnan(value), value).try_cast(kind).alias(name)


def read_scoring_csv(spark: SparkSession, path: str, max_rows: int | None = None) -> DataFrame:
    """CSV to score. Known columns get their type, others stay text: no inference pass over the data.

    A value that is there but unreadable becomes null; ``unreadable_values`` counts them.
    """
    text = read_raw_customers(spark, path)
    df = text.select(*[_typed(x) for x in text.columns])
    if df.isEmpty():
        raise ValueError("the file holds no rows")
    if max_rows is not None and df.limit(max_rows + 1).count() > max_rows:
        raise ValueError(f"the file holds more than {max_rows} rows")
    return df


def unreadable_values(spark: SparkSession, path: str) -> DataFrame:
    """One row for each known numeric column of a scoring CSV: values that are present but no number of its kind."""
    text = read_raw_customers(spark, path)
    names = [x for x in text.columns if not isinstance(_KNOWN_TYPES.get(x, StringType()), StringType)]
    counts = text.agg(*[F.count_if((F.trim(f"`{x}`") != "") & _typed(x).isNull()).alias(x) for x in names])
    return counts.select(F.explode(F.array(*[
        F.struct(F.lit(x).alias("column"), F.col(f"`{x}`").alias("unreadable")) for x in names])).alias("r")).select("r.*")


def is_utf8(spark: SparkSession, path: str) -> bool:
    """Whether every line is valid UTF-8; the text source hands the bytes through as they are."""
    return spark.read.text(path).where(~F.is_valid_utf8("value")).isEmpty()


def read_training_csv(spark: SparkSession, path: str) -> DataFrame:
    """Labelled CSV of any shape with inferred types; UTF-8, else Latin-1."""
    encoding = "UTF-8" if is_utf8(spark, path) else "ISO-8859-1"
    df = spark.read.options(header=True, inferSchema=True, encoding=encoding).csv(path)
    if len(df.columns) < c.MIN_TRAINING_COLUMNS:
        raise ValueError(f"at least {c.MIN_TRAINING_COLUMNS} columns are needed")
    rows = df.limit(c.MIN_TRAINING_ROWS).count()
    if rows < c.MIN_TRAINING_ROWS:
        raise ValueError(f"{rows} rows found, at least {c.MIN_TRAINING_ROWS} are needed")
    return df


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Operational table with its declared schema."""
    return spark.read.schema(schemas.TABLES[name]).parquet(f"{folder}/{name}")


def register_tables(spark: SparkSession, folder: str, names=tuple(schemas.TABLES)) -> None:
    for name in names:
        read_table(spark, folder, name).createOrReplaceTempView(name)


def write_cleaned(df: DataFrame, path: str, file_format: str = "parquet") -> None:
    df.write.mode("overwrite").option("header", True).format(file_format).save(path)


def write_scored(df: DataFrame, path: str) -> None:
    """Scored rows without the nested recommendations, one folder per risk category."""
    df.drop("recommendations").write.mode("overwrite").partitionBy("risk_category").parquet(path)


def export_scored_csv(df: DataFrame, path: str) -> None:
    """Scored rows as CSV; nested columns are left out."""
    nested = [f.name for f in df.schema if f.dataType.typeName() in ("array", "struct", "map")]
    df.drop(*nested).write.mode("overwrite").option("header", True).csv(path)


def write_report(report: DataFrame, path: str) -> None:
    """One-row frame as one JSON document."""
    report.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")) \
        .write.mode("overwrite").text(path)


def append_rows(df: DataFrame, folder: str, name: str) -> None:
    """Append to an operational table, aligned to its schema."""
    schema = schemas.TABLES[name]
    aligned = [F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name)
               for f in schema]
    df.select(*aligned).write.mode("append").parquet(f"{folder}/{name}")
