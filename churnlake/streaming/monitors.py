"""Structured Streaming: call metrics and alerts from file sources.

Calls are summed into panes: one row for each stretch of time and key with counts, sums and a sketch of the users. Every trigger writes the panes
of its own rows under its batch number, so a repeated batch changes nothing, no state is kept between triggers, and what is written does
not depend on the windows asked for later. A window of any length is put together from its panes when it is read: sums are added,
sketches united.

A pane is closed once the newest call of earlier triggers is ``lateness`` past its end. Calls that come later still don't change it: they are
written whole to a table of late rows with their batch, and ``merge_late`` adds them to the panes when the operator says so. Nothing is
lost in between, however often the stream stops and goes on.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from churnlake import schemas
from churnlake.operators.alerts import alerts
from churnlake.session import work_path
from churnlake.sources.adapters import calls_from_events

SKETCH_BITS = 12        # 4,096 registers: a standard error of 1.6 %


def event_stream(spark: SparkSession, path: str, schema: StructType = schemas.EVENT, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


# -- panes -----------------------------------------------------------------------------------------
def _bucket(ts: Column, seconds: int) -> Column:
    return F.timestamp_seconds(F.floor(F.unix_seconds(ts.cast("timestamp")) / seconds) * seconds).cast("timestamp_ntz")


def pane_sums(calls: DataFrame, seconds: int, keys: list[str] = ()) -> DataFrame:
    """Rows (pane, keys, calls, errors, duration, users, last): ``users`` is a sketch, ``last`` the newest call. Batch or one trigger; a
    call without a time has no pane."""
    return calls.where(F.col("created_at").isNotNull()).groupBy(_bucket(F.col("created_at"), seconds).alias("pane"), *keys).agg(
        F.count("*").alias("calls"), F.count_if(F.col("status_code") >= 500).alias("errors"),
        F.sum(F.col("duration_ms").cast("decimal(18,4)")).alias("duration"),
        F.hll_sketch_agg(F.when(F.col("user_id") != 0, F.col("user_id")), SKETCH_BITS).alias("users"),     # 0 and null are not users
        F.max("created_at").alias("last"))


def merged_panes(panes: DataFrame, keys: list[str] = ()) -> DataFrame:
    """One row for each pane and key from the parts that several triggers wrote."""
    return panes.groupBy("pane", *keys).agg(
        F.sum("calls").alias("calls"), F.sum("errors").alias("errors"), F.sum("duration").alias("duration"),
        F.hll_union_agg("users").alias("users"), F.max("last").alias("last"))


@dataclass
class PaneLog:
    """The panes and late rows of one call stream, below ``base``."""

    spark: SparkSession
    base: str
    seconds: int
    lateness: int
    keys: list[str]

    def _parts(self) -> DataFrame:
        empty = pane_sums(self.spark.createDataFrame([], schemas.API_CALL), self.seconds, self.keys)
        schema = StructType([*empty.schema.fields, StructField("batch", LongType())])
        return self.spark.read.schema(schema).parquet(f"{self.base}/panes")

    def panes(self) -> DataFrame:
        return merged_panes(self._parts(), self.keys)

    def late_rows(self) -> DataFrame:
        """Calls that came after their pane was closed, with the batch that brought them."""
        schema = StructType([*schemas.API_CALL.fields, StructField("batch", LongType())])
        return self.spark.read.schema(schema).parquet(f"{self.base}/late")

    def _closed_before(self, batch: int) -> Column | None:
        """The end of what earlier triggers closed; the same however often a batch is repeated."""
        if batch == 0:
            return None
        newest = self._parts().where((F.col("batch") >= 0) & (F.col("batch") < batch)).agg(F.max("last")).first()[0]
        return None if newest is None else F.lit(newest).cast("timestamp_ntz") - F.make_dt_interval(secs=F.lit(self.lateness))

    def add(self, calls: DataFrame, batch: int) -> None:
        """Write one trigger's calls."""
        calls = calls.select(*schemas.API_CALL.names).persist()
        closed = self._closed_before(batch)
        end = _bucket(F.col("created_at"), self.seconds) + F.make_dt_interval(secs=F.lit(self.seconds))
        late = F.lit(False) if closed is None else F.coalesce(end <= closed, F.lit(False))
        calls.where(late).write.mode("overwrite").parquet(f"{self.base}/late/batch={batch}")
        pane_sums(calls.where(~late), self.seconds, self.keys).write.mode("overwrite").parquet(f"{self.base}/panes/batch={batch}")
        calls.unpersist()

    def merge_late(self) -> None:
        """Add every late row to its pane. Late rows of batch n become the panes of batch -n - 1, so that merging again, or after a
        failure half way, changes nothing."""
        batches = [r["batch"] for r in self.late_rows().select("batch").distinct().collect()]       # triggers that had late rows
        for batch in batches:
            rows = self.late_rows().where(F.col("batch") == batch)
            pane_sums(rows, self.seconds, self.keys).write.mode("overwrite").parquet(f"{self.base}/panes/batch={-batch - 1}")

    def windows(self, length: int | None = None, slide: int | None = None) -> DataFrame:
        return windows_of(self.panes(), self.seconds, length or self.seconds, slide, self.keys)


def windows_of(panes: DataFrame, seconds: int, length: int, slide: int | None = None, keys: list[str] = ()) -> DataFrame:
    """Windows of ``length`` seconds every ``slide`` (by default ``length``) from panes of ``seconds``: a pane is copied to its windows, a call
    never is. ``users`` is the estimate of the united sketches, ``sketch`` the union itself."""
    slide = slide or length
    if slide % seconds or length % slide:
        raise ValueError("slides are whole panes, and windows whole slides")
    starts = F.transform(F.sequence(F.lit(0), F.lit(length // slide - 1)),
                         lambda i: _bucket(F.col("pane"), slide) - F.make_dt_interval(secs=i * slide))
    copies = panes.withColumn("window_start", F.explode(starts))
    return copies.groupBy("window_start", *keys).agg(
        F.sum("calls").alias("calls"), F.sum("errors").alias("errors"), F.sum("duration").alias("duration"),
        F.hll_union_agg("users").alias("sketch")).select(
        "window_start", (F.col("window_start") + F.make_dt_interval(secs=F.lit(length))).alias("window_end"), *keys,
        "calls", "errors", "duration", F.hll_sketch_estimate("sketch").alias("users"), "sketch")


def daily_users(panes: DataFrame) -> DataFrame:
    """Distinct users a day from the sketches of its panes; no call is read again."""
    return panes.groupBy(F.to_date("pane").alias("day")).agg(F.hll_sketch_estimate(F.hll_union_agg("users")).alias("active_users"))


def run_panes(events: DataFrame, name: str, seconds: int = 60, lateness: int = 0, keys: list[str] = (), path: str | None = None) -> PaneLog:
    """Process all events there are, then stop. ``lateness`` is how many seconds a pane stays open behind the newest call of earlier
    triggers. With the same ``path`` a stream goes on where it stopped."""
    spark = events.sparkSession
    log = PaneLog(spark, path or work_path(spark, f"stream-{name}"), seconds, lateness, list(keys))
    query = (
        calls_from_events(events).writeStream.foreachBatch(log.add)
        .option("checkpointLocation", f"{log.base}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return log


def call_metrics(windows: DataFrame) -> DataFrame:
    """Windows as metric points: one row per window and metric."""
    points = F.explode(F.array(*[
        F.struct(F.lit(n).alias("name"), F.col(x).cast("double").alias("value"))
        for n, x in (("api_calls", "calls"), ("api_errors", "errors"), ("active_users", "users"))]))
    return windows.select("window_start", "window_end", points.alias("p")).select(
        F.col("p.name").alias("metric_name"), F.col("p.value").alias("metric_value"),
        F.lit(None).cast("string").alias("metric_label"), "window_start", "window_end")


def alert_stream(predictions: DataFrame, customers: DataFrame) -> DataFrame:
    """Alerts of a prediction stream against the customer table."""
    attributes = customers.select(F.col("customerID").alias("customer_id"), "MonthlyCharges", "InactiveDays")
    return alerts(predictions.join(attributes, "customer_id", "left"))


def run_available(stream: DataFrame, name: str, path: str | None = None, mode: str = "append") -> DataFrame:
    """Process everything there is, then stop; returns the written table."""
    spark = stream.sparkSession
    base = path or work_path(spark, f"stream-{name}")
    query = (
        stream.writeStream.format("parquet").outputMode(mode).option("path", f"{base}/data")
        .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/data")
