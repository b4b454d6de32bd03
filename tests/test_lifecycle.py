"""Intermediate tables live as long as their job."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from churnlake.operators import ordering
from churnlake.plans import batch_run
from churnlake.session import finished, intermediate_tables, remove_path, shared_folder, staged, work_path


def below(spark) -> set:
    """Folders of the shared folder that hold tables of this library."""
    folder = f"{shared_folder(spark).removeprefix('file://')}/churnlake"
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


def test_only_the_result_stays(spark):
    before = below(spark)
    df = spark.range(300).withColumn("x", F.col("id") % 7)

    def job():
        numbered = ordering.with_row_number(staged(df, "step"), [F.col("x"), F.col("id")])
        assert len(below(spark) - before) >= 2          # the step and the frozen sort are there while the job runs
        return numbered

    result = finished(spark, "result", job)
    assert result.count() == 300 and result.agg(F.max("row_number")).first()[0] == 300
    (left,) = below(spark) - before
    assert left.startswith("result-")


def test_failed_and_nested_jobs(spark):
    before = below(spark)
    with pytest.raises(RuntimeError):
        with intermediate_tables(spark):
            staged(spark.range(3), "doomed")
            raise RuntimeError
    assert below(spark) == before
    with intermediate_tables(spark):
        outer = finished(spark, "inner", lambda: staged(spark.range(5), "deep").where("id > 1"))
        assert outer.count() == 3 and {x.split("-")[0] for x in below(spark) - before} == {"inner"}
    assert below(spark) == before
    remove_path(spark, f"{shared_folder(spark)}/churnlake/never-there")


def test_scopes_of_threads_are_their_own(spark):
    before = below(spark)
    made = []
    with intermediate_tables(spark):
        worker = threading.Thread(target=lambda: made.append(staged(spark.range(4), "other")))
        worker.start()
        worker.join()
    assert made[0].count() == 4 and len(below(spark) - before) == 1         # a thread without a scope keeps its table


def test_batch_run_leaves_its_outputs(spark, customers):
    raw = customers.withColumns({f.name: F.col(f.name).cast("string") for f in customers.schema})
    path = work_path(spark, "life-run")
    before = below(spark)
    result = batch_run.run_batch(raw, path, ["logistic_regression"], 1)
    assert below(spark) - before == {os.path.basename(path)}
    assert result.report.count() == 1 and spark.read.parquet(f"{path}/scored").count() == 150
