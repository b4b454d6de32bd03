"""An index for pages of a table in a total order.

The index holds the sort columns and the key of every row with its row number, in slices of ``slice_rows`` numbers, sorted once. A page reads the
slices it touches, two at most, and then its own rows of the payload: the key and the range of its values reach the scan, or only the keys' buckets are
read where the payload is a bucketed table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from churnlake.operators.bucketed import BucketedTable
from churnlake.operators.ordering import clamp_page, with_row_number

SLICE_ROWS = 100_000


@dataclass
class PageIndex:
    spark: SparkSession
    path: str
    key: str
    slice_rows: int
    kind: str               # type of the key

    @classmethod
    def create(cls, df: DataFrame, key: str, order: list[tuple[str, bool]], path: str, slice_rows: int = SLICE_ROWS) -> "PageIndex":
        """Sort the columns of ``order`` (name, descending) and the key, nothing else, and write numbers and keys in slices."""
        narrow = df.select(*dict.fromkeys([key, *[x for x, _ in order]]))
        placed = with_row_number(narrow, [F.desc(x) if down else F.asc(x) for x, down in order], "row")
        placed.select("row", key, F.floor((F.col("row") - 1) / slice_rows).alias("slice")).repartition(
            "slice").sortWithinPartitions("row").write.partitionBy("slice").parquet(path)
        return cls(df.sparkSession, path, key, slice_rows, df.schema[key].dataType.simpleString())

    def entries(self, page: int, size: int) -> DataFrame:
        """Rows (row, key) of a page; other slices are not read."""
        page, size = clamp_page(page, size)
        first, last = (page - 1) * size + 1, page * size
        slices = range((first - 1) // self.slice_rows, (last - 1) // self.slice_rows + 1)
        stored = self.spark.read.schema(f"row long, `{self.key}` {self.kind}, slice long").parquet(self.path)
        return stored.where(F.col("slice").isin(*slices) & F.col("row").between(first, last)).select("row", self.key)

    def page(self, payload: DataFrame | BucketedTable, page: int, size: int) -> DataFrame:
        """The rows of a page in order; the key is unique in the payload."""
        found = {r[self.key]: r["row"] for r in self.entries(page, size).collect()}         # a page at most
        rows = payload.rows_of(list(found)) if isinstance(payload, BucketedTable) else payload.where(F.col(self.key).isin(list(found)))
        numbers = self.spark.createDataFrame([(k, n) for k, n in found.items()], f"`{self.key}` {self.kind}, _row long")
        return rows.join(F.broadcast(numbers), self.key).orderBy("_row").select(*rows.columns)
