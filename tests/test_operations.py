"""Latest rows, monitoring windows, alerts and streams."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from churnlake.operators import activity, alerts, audit, monitoring
from churnlake.plans import entities
from churnlake.sources import adapters
from churnlake.streaming import monitors

T0 = datetime(2024, 1, 1)


def test_latest_definitions(spark):
    rows = [(1, 7, T0), (2, 7, T0 + timedelta(days=1)), (3, 7, T0 + timedelta(days=1)), (4, 8, T0), (5, None, T0)]
    df = spark.createDataFrame(rows, "prediction_id long, customer_id long, created_at timestamp_ntz")
    assert {(r.customer_id, r.prediction_id) for r in activity.latest_per_customer(df).collect()} == {(7, 3), (8, 4), (None, 5)}
    assert {r.prediction_id for r in activity.latest_with_ties(df).collect()} == {2, 3, 4}


def test_trailing_series_by_brute_force(spark):
    """One path holds most calls; windows cross bucket borders and include both ends."""
    draw = random.Random(3)
    calls = [("hot" if i % 4 else "cold", T0 + timedelta(seconds=draw.randint(0, 5000), microseconds=draw.randint(0, 999999)),
              float(i % 9)) for i in range(600)] + [("edge", T0, 1.0), ("edge", T0 + timedelta(seconds=900), 2.0),
                                                    ("edge", T0 + timedelta(seconds=1801), 4.0)]
    df = spark.createDataFrame(calls, "path string, created_at timestamp_ntz, duration_ms double")
    found = {(r.path, r.second): (r.calls, r.total) for r in monitoring.trailing_series(df, ["path"], "duration_ms").collect()}
    floor = [(p, t.replace(microsecond=0), v) for p, t, v in calls]
    expected = {}
    for path, at, _ in floor:
        inside = [v for p, t, v in floor if p == path and at - timedelta(seconds=900) <= t <= at]
        expected[path, at] = (len(inside), sum(inside))
    assert found == expected
    assert found["edge", T0 + timedelta(seconds=900)] == (2, 3.0)


def test_trailing_totals_boundary(spark):
    rows = [(T0, 5.0), (T0 + timedelta(seconds=1), 6.0), (T0 + timedelta(seconds=901), 7.0)]
    df = spark.createDataFrame(rows, "created_at timestamp_ntz, v double")
    assert tuple(monitoring.trailing_totals(df, "v").first()) == (2, 13.0, 6.5)
    assert tuple(monitoring.trailing_totals(df, "v", T0 + timedelta(hours=9)).first()) == (0, 0.0, 0.0)


def test_error_rate_of_nothing(spark):
    df = spark.createDataFrame([], "status_code int, user_id long")
    assert tuple(monitoring.error_rate(df).first()) == (0, 0, 0.0)


def test_active_users(spark):
    df = spark.createDataFrame([(1,), (1,), (0,), (None,), (2,)], "user_id long")
    assert monitoring.active_users(df).first().active_users == 2


def test_alert_rule_and_message(spark):
    rows = [(1, 10, 0.65, "High", 0, 100.0), (2, 11, 0.45, "Medium", 30, 2000.0), (3, 12, 0.45, "Medium", 29, 1.0),
            (4, None, 0.4499, "Medium", 90, 1.0)]
    df = spark.createDataFrame(rows, "prediction_id long, customer_id long, churn_probability double, prediction_label string, "
                                     "InactiveDays int, MonthlyCharges double").withColumn("created_at", F.lit(T0))
    found = {r.prediction_id: r for r in alerts.alerts(df).collect()}
    assert set(found) == {1, 2} and found[1].alert_type == "high_risk" and found[2].alert_type == "medium_risk"
    assert found[2].message == ("Customer #11 flagged with 45.0% churn probability. Risk: Medium. Inactive: 30 days. "
                                "Annual revenue at risk: $10,800.")
    assert found[1].top_action == "No specific action."


def test_trend_uses_true_timestamps(spark):
    rows = [(1, T0 - timedelta(days=7), 0.5, "Medium"), (2, T0 - timedelta(days=7, seconds=1), 0.5, "High"), (3, T0, 0.7, "High")]
    df = spark.createDataFrame(rows, "prediction_id long, created_at timestamp_ntz, churn_probability double, prediction_label string")
    assert [(r.total, r.high) for r in activity.daily_trend(df).collect()] == [(1, 0), (1, 1)]


def test_audit_flags_problems(spark):
    df = spark.createDataFrame([(1, -1, 0.0, "Weekly", "x", "Maybe"), (1, 300, 500.0, None, "y", "Yes")],
                               "customerID long, tenure int, MonthlyCharges double, Contract string, PaymentMethod string, Churn string")
    failed = {r.check for r in audit.audit(df).collect() if not r.passed}
    assert failed == {"tenure_non_negative", "charges_positive", "target_domain", "contract_domain", "p99_charge", "max_tenure",
                      "null_Contract", "duplicate_rate"}
    assert audit.audit(df.drop("Churn")).first().value == 1.0


def test_stream_alerts_equal_batch(spark, folder):
    orders = adapters.table(spark, folder, "orders")
    stream = spark.readStream.schema(orders.schema).parquet(f"{folder}/orders.parquet*")
    found = monitors.run_available(monitors.alert_stream(adapters.predictions_from_orders(stream), adapters.customers(spark, folder)), "t")
    batch = entities.alert_table(spark, folder).select(*found.columns)
    assert found.count() == batch.count() and found.exceptAll(batch).isEmpty()


def same(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def batch_windows(calls, minutes):
    """Sums per window straight from the calls."""
    window = F.window(F.col("created_at").cast("timestamp"), f"{minutes} minutes").alias("w")
    return calls.groupBy(window, "path").agg(F.count("*").alias("calls"), F.count_if(F.col("status_code") >= 500).alias("errors"),
                                             F.sum(F.col("duration_ms").cast("decimal(18,4)")).cast("double").alias("duration")).select(
        F.col("w.start").cast("timestamp_ntz").alias("window_start"), "path", "calls", "errors", "duration")


def shown(windows):
    return windows.select("window_start", "path", "calls", "errors", F.col("duration").cast("double").alias("duration"))


def test_stream_windows_equal_batch(spark, folder):
    events = monitors.event_stream(spark, f"{folder}/events.parquet*")
    log = monitors.run_panes(events, "t", 300, keys=["path"])
    calls = adapters.api_calls(spark, folder)
    for minutes in (5, 15, 60):
        assert same(shown(log.windows(60 * minutes)), batch_windows(calls, minutes))
    sliding = log.windows(900, 300).groupBy("path").agg(F.sum("calls").alias("n"))
    assert same(sliding, calls.groupBy("path").agg((3 * F.count("*")).alias("n")))      # each call is in three windows
    assert log.late_rows().isEmpty()
    with pytest.raises(ValueError):
        log.windows(400)


def test_panes_do_not_depend_on_windows(spark, folder):
    """What a trigger writes has a row for each pane it touched, however long the windows are and however many overlap."""
    log = monitors.run_panes(monitors.event_stream(spark, f"{folder}/events.parquet*"), "t", 60)
    minutes = adapters.api_calls(spark, folder).select(F.date_trunc("minute", "created_at")).distinct().count()
    assert log.panes().count() == minutes == log._parts().count()
    assert log.windows(3600, 60).agg(F.sum("calls")).first()[0] == 60 * 1000


def test_late_rows_of_a_second_run(spark, folder):
    """500 newer events, then 500 older ones, in two runs: late ones wait in their table, and merged they give the batch windows."""
    from churnlake.session import work_path
    path = work_path(spark, "late-files")
    events = adapters.table(spark, folder, "events")
    newer = [r.event_id for r in events.orderBy(F.desc("ts")).limit(500).collect()]
    events.where(F.col("event_id").isin(newer)).write.mode("append").parquet(path)

    def run():
        return monitors.run_panes(monitors.event_stream(spark, path), "t", 900, 600, ["path"], f"{path}-log")
    first = run()
    assert first.late_rows().isEmpty() and first.windows().agg(F.sum("calls")).first()[0] == 500
    events.where(~F.col("event_id").isin(newer)).write.mode("append").parquet(path)
    for _ in range(3):          # again, with nothing new
        second = run()
        late, in_time = second.late_rows().count(), second.windows().agg(F.sum("calls")).first()[0]
        assert late > 400 and late + in_time == 1000
    assert {r.batch for r in second.late_rows().select("batch").distinct().collect()} == {1}
    calls = adapters.api_calls(spark, folder)
    for _ in range(2):          # merging twice adds nothing
        second.merge_late()
        assert same(shown(second.windows()), batch_windows(calls, 15))
    assert run().windows().agg(F.sum("calls")).first()[0] == 1000       # and the stream goes on with what was merged


def test_stream_of_many_files(spark, folder):
    """One file a trigger: with panes left open the same table as in one trigger, else the rest of it is in the late rows."""
    from churnlake.session import work_path
    path = work_path(spark, "event-files")
    spark.read.parquet(f"{folder}/events.parquet").repartition(4, F.xxhash64("event_id")).write.parquet(path)
    calls = adapters.api_calls(spark, folder)

    def log(lateness):
        return monitors.run_panes(monitors.event_stream(spark, path, files_per_trigger=1), "t", 900, lateness, ["path"])

    patient = log(3650 * 86400)
    assert patient.late_rows().isEmpty() and same(shown(patient.windows()), batch_windows(calls, 15))
    hasty = log(60)
    late = hasty.late_rows()
    assert late.count() > 0 and late.count() + hasty.windows().agg(F.sum("calls")).first()[0] == 1000
    hasty.merge_late()
    assert same(shown(hasty.windows()), batch_windows(calls, 15))


def test_repeated_batch_changes_nothing(spark, folder):
    """A trigger that is run again after a failure writes the same panes and late rows."""
    from churnlake.session import work_path
    calls = adapters.api_calls(spark, folder)
    middle = calls.agg(F.expr("percentile_approx(created_at, 0.5)")).first()[0]
    log = monitors.PaneLog(spark, work_path(spark, "again"), 900, 60, [])
    log.add(calls.where(F.col("created_at") >= F.lit(middle)), 0)
    log.add(calls.where(F.col("created_at") < F.lit(middle)), 1)
    once = (log.panes().drop("users").collect(), log.late_rows().count())
    log.add(calls.where(F.col("created_at") < F.lit(middle)), 1)
    log.add(calls.where(F.col("created_at") >= F.lit(middle)), 0)
    assert (sorted(log.panes().drop("users").collect()), log.late_rows().count()) == (sorted(once[0]), once[1])


def test_user_sketches(spark):
    """United sketches of panes and days stay within 5 % of the exact count; null and 0 are no users."""
    rng = random.Random(6)
    rows = [(i, "p", 200, rng.choice([None, 0]) if i % 50 == 0 else rng.randrange(1, 9000), 1.0, T0 + timedelta(seconds=5 * i)) for i in range(40_000)]
    calls = spark.createDataFrame(rows, "id long, path string, status_code int, user_id long, duration_ms double, created_at timestamp_ntz")
    panes = monitors.pane_sums(calls, 600)
    users = {d: {r[3] for r in rows if r[5].date() == d and r[3]} for d in {r[5].date() for r in rows}}
    got = {r.day: r.active_users for r in monitors.daily_users(panes).collect()}
    assert got.keys() == users.keys()
    assert all(abs(got[d] - len(users[d])) <= max(1, 0.05 * len(users[d])) for d in got)
    hours = monitors.windows_of(panes, 600, 3600)
    again = hours.groupBy(F.to_date("window_start").alias("day")).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n"))
    assert {r.day: r.n for r in again.collect()} == pytest.approx(got, rel=0.02)        # from hours as from panes


def test_restarted_stream_adds_nothing(spark, folder):
    from churnlake.session import work_path
    path = work_path(spark, "restart")

    def once():
        events = monitors.event_stream(spark, f"{folder}/events.parquet*")
        return monitors.run_available(adapters.calls_from_events(events), "log", path).count()
    assert once() == once() == 1000


def test_trailing_series_keeps_a_running_sum(spark):
    """Full windows, an edge at exactly the window's length and one second beyond it; the plan has no sliding frame."""
    at = [T0 + timedelta(seconds=x) for x in (*range(0, 40), 900, 939, 940, 1801)]
    df = spark.createDataFrame([("a", x, float(i)) for i, x in enumerate(at)], "path string, created_at timestamp_ntz, duration_ms double")
    rows = monitoring.trailing_series(df, ["path"], "duration_ms")
    found = {r.second: (r.calls, r.total) for r in rows.collect()}
    for x in at:
        inside = [i for i, y in enumerate(at) if x - timedelta(seconds=900) <= y <= x]
        assert found[x] == (len(inside), float(sum(inside)))
    assert "unboundedpreceding" in rows._jdf.queryExecution().optimizedPlan().toString().lower()
