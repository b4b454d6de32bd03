"""Bucketed tables and page indexes: what is read and written, and the same results as the snapshot forms."""

import os

import pytest
from pyspark.sql import functions as F

from churnlake.operators import maintenance
from churnlake.operators.bucketed import BucketedTable
from churnlake.operators.paging import PageIndex


def files(table: BucketedTable) -> dict[int, set]:
    """Names and times of the files of every bucket."""
    found = {}
    for bucket, data in table.manifest().items():
        folder = f"{table.path}/data/{data}/_bucket={bucket}"
        found[bucket] = {(x, os.stat(f"{folder}/{x}").st_mtime_ns) for x in os.listdir(folder) if x.endswith(".parquet")}
    return found


def same(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([(i % 97 if i % 31 else None, i, f"n{i % 5}", i % 2 == 0) for i in range(400)],
                                 "k long, i long, name string, is_active boolean")


def test_changes_equal_the_snapshot_forms(spark, rows, tmp_path):
    table = BucketedTable.create(rows, str(tmp_path / "t"), "k", 16)
    assert same(table.read(), rows) and set(table.manifest()) <= set(range(16))
    new = spark.createDataFrame([(3, 1000, "new", True), (200, 1001, "new", None), (None, 1002, "null", None)], rows.schema)
    changes = spark.createDataFrame([(5, "renamed", 7), (6, None, 8), (9999, "nobody", 1)], "k long, name string, i long")
    steps = [
        (lambda: table.append(new), lambda t: maintenance.append(t, new)),
        (lambda: table.update(changes, maintenance.USER_UPDATES), lambda t: maintenance.update_by_key(t, changes, "k", maintenance.USER_UPDATES)),
        (lambda: table.replace(new.limit(2)), lambda t: maintenance.replace_by_key(t, new.limit(2), "k")),
        (lambda: table.delete(changes.select("k", F.lit(105).cast("long").alias("i")), ["k", "i"]),
         lambda t: maintenance.delete_by_key(t, changes.select("k", F.lit(105).cast("long").alias("i")), ["k", "i"])),
        (lambda: table.insert_if_absent(new.withColumn("k", F.col("i")), ["i"]),
         lambda t: maintenance.insert_if_absent(t, new.withColumn("k", F.col("i")), "k", ["i"])),
    ]
    snapshot = rows
    for change, plain in steps:
        before, all_files = table.manifest(), files(table)
        touched = change()
        snapshot = plain(snapshot)
        assert same(table.read(), snapshot)
        after = files(table)
        untouched = set(before) - set(touched)
        assert 0 < len(touched) <= 3 and untouched
        assert all(after[b] == all_files[b] and table.manifest()[b] == before[b] for b in untouched)
    assert table.version() == len(steps)


def test_reads_only_some_buckets(spark, rows, tmp_path):
    table = BucketedTable.create(rows, str(tmp_path / "t"), "k", 16)
    some = table.rows_of([5, 40])
    assert same(some, rows.where(F.col("k").isin(5, 40)))
    assert {f.split("_bucket=")[1].split("/")[0] for f in some.inputFiles()} == {str(b) for b in table.touched(rows.where("k in (5, 40)"))}


def test_emptied_buckets_and_nothing_to_do(spark, tmp_path):
    rows = spark.createDataFrame([(i, "x") for i in range(5)], "k long, name string")
    table = BucketedTable.create(rows, str(tmp_path / "t"), "k", 4)
    table.delete(rows)
    assert table.manifest() == {} and table.read().isEmpty() and table.read().columns == ["k", "name"]
    assert table.delete(rows.limit(0)) == [] and table.version() == 1
    table.append(rows)
    assert same(table.read(), rows)
    empty = BucketedTable.create(rows.limit(0), str(tmp_path / "e"), "k", 4)
    assert empty.read().isEmpty() and empty.rows_of([1]).isEmpty()
    empty.append(rows)
    assert same(empty.read(), rows)


def test_failed_and_wrong_changes_leave_the_table(spark, rows, tmp_path):
    """A change that fails half way, one that touches other keys, and a second one of the same version."""
    table = BucketedTable.create(rows, str(tmp_path / "t"), "k", 16)
    one = rows.where("k = 5")
    with pytest.raises(Exception, match="boom"):
        table.change(one, lambda r: r.withColumn("name", F.raise_error(F.lit("boom")).cast("string")))
    assert same(table.read(), rows) and table.version() == 0
    table.delete(one)           # and the next one goes through
    assert same(table.read(), rows.where("k is null or k <> 5")) and table.version() == 1
    other = BucketedTable.create(rows, str(tmp_path / "o"), "k", 16)
    with pytest.raises(ValueError):
        other.change(one, lambda r: r.withColumn("k", F.col("k") + 1))
    assert same(other.read(), rows)
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        other._commit({0: "x"}, 0)


def test_hot_key_in_its_bucket(spark, tmp_path):
    """A key with most of the rows stays right through changes of its own and of other buckets."""
    rows = spark.range(5000).select(F.when(F.col("id") % 3 != 0, 1).otherwise(F.col("id")).alias("k"), "id")
    table = BucketedTable.create(rows, str(tmp_path / "t"), "k", 8)
    table.delete(rows.where("k = 9").select("k"))
    table.delete(spark.createDataFrame([(1, 4), (1, 5)], "k long, id long"), ["k", "id"])
    assert same(table.read(), rows.where("k <> 9 and id not in (4, 5)"))


@pytest.mark.parametrize("slice_rows", [7, 64, 1000])
def test_pages_by_index(spark, rows, tmp_path, slice_rows):
    keyed = rows.withColumn("id", F.col("i") * 3)
    order = [F.asc("name"), F.desc("k"), F.desc("id")]
    expected = [tuple(r) for r in keyed.orderBy(*order).collect()]
    index = PageIndex.create(keyed, "id", [("name", False), ("k", True), ("id", True)], str(tmp_path / "i"), slice_rows)
    table = BucketedTable.create(keyed, str(tmp_path / "t"), "id", 8)
    for page, size in ((1, 10), (3, 25), (16, 25), (17, 25), (0, 5)):
        first = (max(page, 1) - 1) * size
        for payload in (keyed, table):
            assert [tuple(r) for r in index.page(payload, page, size).collect()] == expected[first:first + size]
    entries = index.entries(3, 25)
    assert {f.split("slice=")[1].split("/")[0] for f in entries.inputFiles()} >= {str(50 // slice_rows)}
    plan = entries._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(slice" in plan or "PartitionFilters: [slice" in plan       # other slices are pruned
