"""Session settings and the shared folder for tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "churnlake", master: str | None = None, shuffle_partitions: int | None = None,
                  **conf: str) -> SparkSession:
    """A session with UTC time, AQE with skew-join splitting, and no web page.

    Shuffle partitions are left to the cluster (start high, AQE coalesces) unless given.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")   # no stack capture per column call
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


_LOCAL_FOLDERS: dict[str, str] = {}     # a local master's own folder, per application


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach: ``spark.checkpoint.dir`` of the session.

    Where it is unset a local master gets a fresh folder of its own; a cluster must name one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    application = spark.sparkContext.applicationId
    if application not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[application] = tempfile.mkdtemp(prefix="churnlake-")
    return _LOCAL_FOLDERS[application]


_SCOPES: ContextVar[tuple[list[str], ...]] = ContextVar("churnlake_scopes", default=())


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, noted in the open scope if there is one."""
    path = f"{shared_folder(spark).rstrip('/')}/churnlake/{name}-{uuid.uuid4().hex}"
    for scope in _SCOPES.get()[-1:]:
        scope.append(path)
    return path


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, in whatever store it is; a missing one is no error."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def intermediate_tables(spark: SparkSession) -> Iterator[list[str]]:
    """A scope of a job: what is staged inside is removed at its end, also when the job fails. Write results that outlast it to paths of
    their own before. Scopes nest; each removes what was staged in itself."""
    paths: list[str] = []
    token = _SCOPES.set((*_SCOPES.get(), paths))
    try:
        yield paths
    finally:
        _SCOPES.reset(token)
        for path in paths:
            remove_path(spark, path)


#: Spark's own setting: the shuffle files of a job go when it has ended.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_table(df: DataFrame, path: str) -> None:
    """Write Parquet; the shuffle files of the write, which no later job reads, go at its end. A lost executor during the write costs its part anew, as ever."""
    conf = df.sparkSession.conf
    before = conf.get(SHUFFLE_CLEANUP, None)
    conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(SHUFFLE_CLEANUP) if before is None else conf.set(SHUFFLE_CLEANUP, before)


#: Spark's own setting: joins of which a side turns out to have no partition above this size hash that side instead of sorting both.
HASHED_JOINS = "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold"


@contextmanager
def hashed_joins(spark: SparkSession, most: str = "64m") -> Iterator[None]:
    """Jobs run inside may hash small partitions; larger ones are sorted as ever."""
    before = spark.conf.get(HASHED_JOINS, None)
    spark.conf.set(HASHED_JOINS, most)
    try:
        yield
    finally:
        spark.conf.unset(HASHED_JOINS) if before is None else spark.conf.set(HASHED_JOINS, before)


def finished(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The rows of ``make()``, written; every table staged on the way is removed. The result belongs to the scope around, if any."""
    path = work_path(spark, name)
    with intermediate_tables(spark):
        rows = make()
        write_table(rows, path)
    return spark.read.schema(rows.schema).parquet(path)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: later stages scan only the columns they need."""
    path = work_path(df.sparkSession, name)
    write_table(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that a task of a fit should have at least, and at most where there are more than a task a core.
LEAST_ROWS, MOST_ROWS = 10_000, 250_000


def spread(df: DataFrame, rows: int) -> DataFrame:
    """A table of ``rows`` rows evenly over all cores, for work that costs by rows: Spark sizes partitions by bytes, and a table of many narrow
    rows may lie in one. Tables too small for two tasks stay as they are."""
    parts = max(min(df.sparkSession.sparkContext.defaultParallelism, rows // LEAST_ROWS), -(-rows // MOST_ROWS))
    return df.repartition(parts) if parts > 1 else df


def over_all_cores(df: DataFrame) -> DataFrame:
    """The same for a table that isn't counted: two tasks a core."""
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Freezes the rows so that later stages all see the same values: a staged table inside a scope, else a reliable checkpoint, which
    Spark's cleaner removes when nothing refers to it any more."""
    if _SCOPES.get():
        return staged(df, "frozen")
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
