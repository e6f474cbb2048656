"""Session helpers: Spark settings and tables written to shared storage."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings the jobs rely on.  Partition counts and memory belong to the
# cluster, so they are left to whoever starts the session.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

#: Each query deletes its shuffle files at its end, not when the driver finds them unused.
SHUFFLES_DELETED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("paceline")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by the cluster.

    Read from ``spark.checkpoint.dir``.  Only a local session may go without:
    it gets a new temporary folder.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if not context.getCheckpointDir():
            context.setCheckpointDir(configured)
        return configured
    if not context.getCheckpointDir():
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="paceline-"))
    return context.getCheckpointDir()


def _own_dir(spark: SparkSession) -> str:
    """Where this application's intermediate tables lie."""
    return f"{shared_dir(spark).rstrip('/')}/paceline/{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cleanup(spark: SparkSession) -> None:
    """Delete this application's intermediate tables, once their last reader is done.

    Results that are still lazy read them, so write those first.
    """
    _delete(spark, _own_dir(spark))


#: Tables written inside the scopes that are open now, innermost last.
_scopes: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that ``materialize`` writes inside are deleted at the end, but for those it is told to keep:
    these go over to the scope around it, if there is one.

    What is to outlive the scope must be written in it, as lazy results read its tables.
    """
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            _delete(spark, path)


def materialize(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written table.

    Later steps then neither recompute it nor lose it with an executor, read
    only the columns they need, and know its size when they pick a join.  Tables
    stay until ``cleanup``, or until the end of ``scratch``; those it is to ``keep`` outlive one
    ``scratch``.  What was shuffled for the table is deleted as soon as it is written.
    """
    spark = df.sparkSession
    path = f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    scopes = _scopes[:-1] if keep else _scopes
    if scopes:
        scopes[-1].append(path)
    with setting(spark, SHUFFLES_DELETED, "true"):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting that holds inside."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def release(spark: SparkSession) -> None:
    """Have the driver look now for shuffle files that nothing reads any more, instead of when its memory fills."""
    gc.collect()
    spark._jvm.System.gc()
