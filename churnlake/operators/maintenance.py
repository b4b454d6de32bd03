"""Table maintenance as set operations: append, replace, update, delete, insert-if-absent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from churnlake.operators.ordering import with_row_number

# columns a change table may touch
CUSTOMER_UPDATES = ["tenure", "MonthlyCharges", "Contract", "PaymentMethod", "SubscriptionType", "InactiveDays",
                    "TotalCharges"]
USER_UPDATES = ["name", "role", "is_active"]
ALERT_UPDATES = ["email_sent", "email_address", "email_status"]


def append(table: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``new`` aligned to the table's columns and types."""
    aligned = [F.col(f.name).cast(f.dataType) if f.name in new.columns else F.lit(None).cast(f.dataType).alias(f.name)
               for f in table.schema]
    return table.unionByName(new.select(*aligned))


def with_new_ids(new: DataFrame, table: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Ids after the table's highest, dense in the given total order."""
    top = table.agg(F.coalesce(F.max(key), F.lit(0)).cast("bigint")).scalar()
    return with_row_number(new, order, "_row").withColumn(key, F.col("_row") + top).drop("_row")


def replace_by_key(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Keys that occur in ``new`` get exactly its rows; other keys keep theirs."""
    return table.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def update_by_key(table: DataFrame, changes: DataFrame, key: str, allowed: list[str], stamp: Column | None = None,
                  stamp_column: str = "updated_at") -> DataFrame:
    """Partial update. ``changes`` has the key and, per changed column, value ``x`` and flag ``set_x``.

    Without a flag column a non-null value counts as set. Columns that are not allowed are ignored.
    """
    names = [x for x in allowed if x in changes.columns]
    flags = [F.coalesce(F.col(f"set_{x}"), F.lit(False)) if f"set_{x}" in changes.columns else F.col(x).isNotNull()
             for x in names]
    patch = changes.select(key, *[flag.alias(f"_set_{x}") for x, flag in zip(names, flags)],
                           *[F.col(x).alias(f"_new_{x}") for x in names])
    joined = table.join(patch, key, "left")
    is_set = {x: F.coalesce(F.col(f"_set_{x}"), F.lit(False)) for x in names}
    out = {x: F.when(is_set[x], F.col(f"_new_{x}").cast(table.schema[x].dataType)).otherwise(F.col(x)) for x in names}
    if stamp is not None and names:
        touched = is_set[names[0]]
        for x in names[1:]:
            touched = touched | is_set[x]
        old = F.col(stamp_column) if stamp_column in table.columns else F.lit(None)
        out[stamp_column] = F.when(touched, stamp).otherwise(old)
    columns = table.columns + [x for x in out if x not in table.columns]
    return joined.withColumns(out).select(*columns)


def delete_by_key(table: DataFrame, doomed: DataFrame, keys: list[str]) -> DataFrame:
    """Delete the rows whose keys are listed; adding the owner column to ``keys`` scopes the delete."""
    return table.join(doomed.select(*keys).distinct(), keys, "left_anti")


def cascade_delete(children: dict[str, DataFrame], doomed: DataFrame, key: str) -> dict[str, DataFrame]:
    """The same delete in every child table."""
    return {name: delete_by_key(child, doomed, [key]) for name, child in children.items()}


def set_null_by_key(table: DataFrame, doomed: DataFrame, key: str) -> DataFrame:
    """Keep the rows but clear links to deleted keys."""
    gone = doomed.select(F.col(key)).distinct().withColumn("_gone", F.lit(True))
    return (table.join(gone, key, "left").withColumn(key, F.when(F.col("_gone").isNull(), F.col(key)))
            .select(*table.columns))


def insert_if_absent(table: DataFrame, new: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Add rows with an unseen key; of several new rows with one key the smallest by ``order`` wins."""
    rest = [x for x in table.columns if x not in (key, *order)]
    first = new.groupBy(key).agg(F.min(F.struct(*order, *rest)).alias("_first")).select(key, "_first.*")
    return table.unionByName(first.join(table, key, "left_anti").select(*table.columns))
