"""Tables laid out by a bucket of their key, changed a few buckets at a time.

A row lies in the bucket of its key's hash. A change reads and writes only the buckets its keys fall into: their new rows go to files of a fresh
folder, and the manifest of a new version says for every bucket which folder holds it. The manifest is written last and as a whole, so readers
see a table before or after a change and never in between, two changes at once can't both become the same version, and the
files of untouched buckets stay as they are. A bucket without rows is in no manifest.

The number of buckets bounds the manifest; choose it so that a bucket is a few hundred megabytes. Within a bucket AQE splits what is too large
for one task, so rows that share a key may be many.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from churnlake.operators import maintenance

_MANIFEST = "bucket long, data string, version long"
_NONE = -1              # every manifest has a row of this bucket, also that of an empty table


@dataclass
class BucketedTable:
    """A stored table; ``key`` is one of its columns."""

    spark: SparkSession
    path: str
    key: str
    buckets: int
    schema: StructType

    # -- layout --------------------------------------------------------------------------------------
    def bucket(self, key: Column | None = None) -> Column:
        kind = self.schema[self.key].dataType
        return F.pmod(F.xxhash64((F.col(self.key) if key is None else key).cast(kind)), F.lit(self.buckets))

    @classmethod
    def create(cls, df: DataFrame, path: str, key: str, buckets: int) -> "BucketedTable":
        table = cls(df.sparkSession, path, key, buckets, df.schema)
        table._commit(table._write(df), 0)
        return table

    def _write(self, rows: DataFrame) -> dict[int, str]:
        """Write rows to a fresh folder; returns it for every bucket that has rows. A change that fails leaves a folder that no
        manifest names, and may be made again."""
        data = uuid.uuid4().hex
        rows.select(*self.schema.names, self.bucket().alias("_bucket")).hint("rebalance", F.col("_bucket")).write.partitionBy(
            "_bucket").parquet(f"{self.path}/data/{data}")
        written = self.spark.read.schema(self._stored()).parquet(f"{self.path}/data/{data}")
        return {r["_bucket"]: data for r in written.select("_bucket").distinct().collect()}

    def _stored(self) -> StructType:
        return StructType([*self.schema.fields, StructField("_bucket", LongType())])

    def _commit(self, placed: dict[int, str], version: int) -> None:
        rows = self.spark.createDataFrame([(_NONE, ""), *sorted(placed.items())], "bucket long, data string")
        rows.coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/manifest/version={version}")

    def version(self) -> int:
        manifests = self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest")
        return manifests.agg(F.max("version")).first()[0] or 0

    def manifest(self) -> dict[int, str]:
        """Folder of every bucket that has rows."""
        rows = self.spark.read.schema("bucket long, data string").parquet(f"{self.path}/manifest/version={self.version()}")
        return {r["bucket"]: r["data"] for r in rows.where(F.col("bucket") != _NONE).collect()}

    # -- reading -------------------------------------------------------------------------------------
    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The rows, or those of some buckets: no other folder is listed or read."""
        placed = self.manifest()
        chosen = [b for b in (placed if buckets is None else buckets) if b in placed]
        paths = [f"{self.path}/data/{placed[b]}/_bucket={b}" for b in chosen]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def touched(self, keys: DataFrame) -> list[int]:
        """Buckets of a table of keys."""
        return sorted(r[0] for r in keys.select(self.bucket(F.col(self.key)).alias("b")).distinct().collect())

    def rows_of(self, keys: list) -> DataFrame:
        """The rows of a few keys."""
        few = self.spark.createDataFrame([(k,) for k in keys], StructType([StructField(self.key, self.schema[self.key].dataType)]))
        return self.read(self.touched(few)).where(F.col(self.key).isin(keys))

    # -- changes -------------------------------------------------------------------------------------
    def change(self, keys: DataFrame, make: Callable[[DataFrame], DataFrame]) -> list[int]:
        """Replace the rows of the keys' buckets by ``make`` of them; returns those buckets."""
        buckets = self.touched(keys)
        if buckets:
            placed, version = self.manifest(), self.version() + 1
            filled = self._write(make(self.read(buckets)))
            if not set(filled) <= set(buckets):
                raise ValueError("a change must not touch keys that it does not list")
            self._commit({b: x for b, x in placed.items() if b not in buckets} | filled, version)
        return buckets

    def append(self, new: DataFrame) -> list[int]:
        return self.change(new, lambda rows: maintenance.append(rows, new))

    def replace(self, new: DataFrame) -> list[int]:
        """Keys of ``new`` get exactly its rows."""
        return self.change(new, lambda rows: maintenance.replace_by_key(rows, new.select(*self.schema.names), self.key))

    def update(self, changes: DataFrame, allowed: list[str], stamp: Column | None = None, stamp_column: str = "updated_at") -> list[int]:
        """Whitelisted partial update; a stamp needs its column in the table."""
        return self.change(changes, lambda rows: maintenance.update_by_key(rows, changes, self.key, allowed, stamp, stamp_column))

    def delete(self, doomed: DataFrame, keys: list[str] | None = None) -> list[int]:
        """Delete listed rows; further columns in ``keys`` scope the delete."""
        return self.change(doomed, lambda rows: maintenance.delete_by_key(rows, doomed, keys or [self.key]))

    def insert_if_absent(self, new: DataFrame, order: list[str]) -> list[int]:
        return self.change(new, lambda rows: maintenance.insert_if_absent(rows, new, self.key, order))
