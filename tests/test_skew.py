"""The same oracles on lopsided tables: a third of the rows on one key, null keys, several files per table."""

import glob
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from compare import difference, duck

QUERIES = ["latest_prediction", "latest_predictions_with_ties", "rule_segments", "risk_distribution", "customer_360",
           "prediction_list", "numbered_predictions", "high_risk_customers", "trailing_series", "top_endpoints", "daily_usage",
           "replace_recommendations", "cascade_delete", "unlink_alerts", "churn_alerts", "executive_summary",
           "stream_call_windows", "stream_alerts", "risk_by_segment", "segment_profile"]


@pytest.fixture(scope="module")
def lopsided(spark, folder, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("lopsided"))
    row = {"orders.parquet": F.col("o_orderkey"), "events.parquet": F.col("event_id")}
    for path in glob.glob(f"{folder}/*.parquet"):
        name, df = os.path.basename(path), spark.read.parquet(path)
        if name == "orders.parquet":
            key = F.when(row[name] % 3 == 0, 7).when(row[name] % 101 == 5, F.lit(None)).otherwise(F.col("o_custkey"))
            df = df.withColumn("o_custkey", key.cast("bigint"))
        if name == "events.parquet":
            df = df.withColumns({"event_type": F.when(row[name] % 3 == 0, "view").otherwise(F.col("event_type")),
                                 "user_id": F.when(row[name] % 3 == 1, 3).otherwise(F.col("user_id")).cast("bigint")})
        df.repartition(3).write.parquet(f"{out}/{name}")
    return out


@pytest.mark.parametrize("name", QUERIES)
def test_query_on_lopsided_tables(spark, lopsided, name):
    assert difference(entry.queries()[name](spark, lopsided), duck(lopsided), entry.oracle_sql()[name]) is None
