"""Rolling and cumulative platform metrics on batch tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from churnlake import config as c
from churnlake.functions.rounding import exact_avg, exact_sum, half_even
from churnlake.operators.activity import combine_rows, daily_trend, moment

TOP_ENDPOINTS = 8


def epoch_seconds(ts: Column) -> Column:
    return F.unix_seconds(ts.cast("timestamp"))


def trailing_series(df: DataFrame, keys: list[str], value: str, ts: str = "created_at",
                    seconds: int = c.TRAILING_SECONDS) -> DataFrame:
    """Per key and active second: count, sum and mean over the trailing window, both ends included.

    Times count in whole seconds here: an event a fraction of a second older than the window is still in it.

    Events are counted per second first. Each second then belongs to its own time bucket and, as
    history, to the next one, where it also leaves the window: a running sum adds and takes away, so a
    task holds two buckets of one key however long the log is, and a second costs the same however many are in its window.
    """
    per_second = df.groupBy(*keys, epoch_seconds(F.col(ts)).alias("second")).agg(
        F.count("*").alias("n"), F.coalesce(exact_sum(F.col(value)), F.lit(0.0)).alias("s"))
    bucket = F.floor(F.col("second") / seconds)

    def home(bucket: Column, own: bool, at: Column, sign: Column) -> Column:
        return F.struct(bucket.alias("bucket"), F.lit(own).alias("own"), at.alias("at"), sign.alias("sign"))
    second = F.col("second")
    homes = F.explode(F.array(home(bucket, True, second, F.lit(1)), home(bucket + 1, False, second, F.lit(1)),
                              home(bucket + 1, False, second + seconds + 1, F.when(second.isNull(), 0).otherwise(-1))))
    window = Window.partitionBy(*keys, "home.bucket").orderBy("home.at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        per_second.withColumn("home", homes)
        .withColumns({"calls": F.sum(F.col("n") * F.col("home.sign")).over(window),
                      "total": exact_sum(F.col("s") * F.col("home.sign"), window)})
        .where("home.own")
        .select(*keys, F.timestamp_seconds("second").cast("timestamp_ntz").alias("second"), "calls",
                "total", half_even(F.col("total") / F.col("calls"), 4).alias("mean"))
    )


def trailing_totals(df: DataFrame, value: str, as_of=None, ts: str = "created_at",
                    seconds: int = c.TRAILING_SECONDS) -> DataFrame:
    """Count, sum and mean of the window that ends at the reference moment."""
    now = moment(as_of, df, ts)
    start = now - F.make_dt_interval(secs=F.lit(seconds))
    mean = F.coalesce(exact_avg(F.col(value)), F.lit(0.0))
    return df.where((F.col(ts) >= start) & (F.col(ts) <= now)).agg(
        F.count("*").alias("calls"), F.coalesce(exact_sum(F.col(value)), F.lit(0.0)).alias("total"),
        half_even(mean, 4).alias("mean"))


def prediction_counters(predictions: DataFrame, label: str = "prediction_label", latency: str | None = None) -> DataFrame:
    """Cumulative predictions by band (unknown bands count as Low) and mean positive latency."""
    band = F.coalesce(F.col(label), F.lit("Low"))
    out = [F.count("*").alias("total_predictions"), F.count_if(band == "High").alias("high_risk_total"),
           F.count_if(band == "Medium").alias("medium_risk_total"),
           F.count_if(~band.isin("High", "Medium")).alias("low_risk_total")]
    if latency:
        positive = F.when(F.col(latency) > 0, F.col(latency))
        out.append(half_even(F.coalesce(exact_avg(positive), F.lit(0.0)), 1).alias("avg_prediction_ms"))
    return predictions.agg(*out)


def top_endpoints(calls: DataFrame, n: int = TOP_ENDPOINTS) -> DataFrame:
    return calls.groupBy("path").agg(F.count("*").alias("calls")).orderBy(F.desc("calls"), "path").limit(n)


def error_rate(calls: DataFrame) -> DataFrame:
    errors = F.count_if(F.col("status_code") >= 500)
    rate = half_even(errors * 100.0 / F.greatest(F.count("*"), F.lit(1)), 2)
    return calls.agg(F.count("*").alias("total_api_calls"), errors.alias("error_count"), rate.alias("error_rate_pct"))


def active_users(calls: DataFrame) -> DataFrame:
    """Distinct users; null and 0 are not users."""
    return calls.agg(F.countDistinct(F.when(F.col("user_id") != 0, F.col("user_id"))).alias("active_users"))


def hourly_calls(calls: DataFrame, as_of=None, hours: int = 24) -> DataFrame:
    """Calls and mean duration per hour of the last hours."""
    start = moment(as_of, calls) - F.make_dt_interval(hours=F.lit(hours))
    hour = F.date_trunc("hour", "created_at").cast("timestamp_ntz").alias("hour")
    return (
        calls.where(F.col("created_at") >= start).groupBy(hour)
        .agg(F.count("*").alias("calls"),
             half_even(F.coalesce(exact_avg(F.col("duration_ms")), F.lit(0.0)), 1).alias("avg_ms")).orderBy("hour")
    )


def dashboard(predictions: DataFrame, calls: DataFrame, as_of=None) -> DataFrame:
    """All one-row metrics together; trailing counts end at the newest call unless a moment is given."""
    now = moment(as_of, calls)
    start = now - F.make_dt_interval(secs=F.lit(c.TRAILING_SECONDS))
    recent = predictions.where((F.col("created_at") >= start) & (F.col("created_at") <= now))
    last = trailing_totals(calls, "duration_ms", as_of)

    def listed(rows: DataFrame, name: str, first: list[str]) -> DataFrame:
        """A bounded frame as one array, ordered by its first fields."""
        fields = [*first, *[x for x in rows.columns if x not in first]]
        return rows.agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))

    endpoints = top_endpoints(calls).select((-F.col("calls")).alias("order"), "path", "calls")
    slowest = F.coalesce(exact_avg(F.when(F.col("latency_ms") > 0, F.col("latency_ms"))), F.lit(0.0)) \
        if "latency_ms" in predictions.columns else F.lit(0.0)
    return combine_rows({
        "predictions": prediction_counters(predictions),
        "latency": predictions.agg(half_even(slowest, 1).alias("avg_prediction_ms")),
        "endpoints": listed(endpoints, "top_endpoints", ["order", "path"]).select(F.transform(
            "top_endpoints", lambda x: F.struct(x["path"].alias("path"), x["calls"].alias("calls"))).alias("top_endpoints")),
        "days": listed(daily_trend(predictions, as_of), "prediction_trend", ["day"]),
        "hours": listed(hourly_calls(calls, as_of), "hourly_calls", ["hour"]),
        "recent": recent.agg(F.count("*").alias("predictions_15min")),
        "errors": error_rate(calls),
        "users": active_users(calls),
        "calls": last.select(F.col("calls").alias("api_calls_15min"), half_even(F.col("mean"), 1).alias("avg_latency_ms")),
    })


def daily_usage(calls: DataFrame, predictions: DataFrame, recommendations: DataFrame) -> DataFrame:
    """One row per day: calls, distinct users, predictions, High customers, completed actions."""
    day = F.to_date("created_at").alias("day")
    parts = [
        calls.groupBy(day).agg(F.count("*").alias("api_calls"),
                               F.countDistinct(F.when(F.col("user_id") != 0, F.col("user_id"))).alias("active_users")),
        predictions.groupBy(day).agg(
            F.count("*").alias("predictions_generated"),
            F.countDistinct(F.when(F.col("prediction_label") == "High", F.col("customer_id")))
            .alias("high_risk_customers")),
        recommendations.groupBy(day).agg(F.count_if("is_completed").alias("retention_actions_taken")),
    ]
    joined = parts[0].join(parts[1], "day", "full").join(parts[2], "day", "full")
    return joined.na.fill(0)


def metric_points(calls: DataFrame) -> DataFrame:
    """Hourly call counts per endpoint as rows of the metrics table."""
    hour = F.date_trunc("hour", "created_at").cast("timestamp_ntz")
    counts = calls.groupBy("path", hour.alias("window_start")).agg(F.count("*").alias("n"))
    return counts.select(
        F.lit("api_calls").alias("metric_name"), F.col("n").cast("double").alias("metric_value"),
        F.col("path").alias("metric_label"), "window_start",
        (F.col("window_start") + F.make_dt_interval(hours=F.lit(1))).alias("window_end"))
