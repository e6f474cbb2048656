"""Where results go: files written in parallel by the executors.

What belongs together is published together.  A version is written whole into a
folder of its own, then named in the list of published versions, by one small
file.  Readers take the version named last, so a failure on the way leaves the old
result as it was, and nobody sees half of a new one.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LIST = "at bigint, version string, format string"


def _named(path: str) -> str:
    return f"{path.rstrip('/')}/_published"


def publish(tables: dict[str, DataFrame], path: str, fmt: str = "parquet") -> str:
    """Write the named tables as one version below ``path`` and make it the one that is read."""
    version = uuid.uuid4().hex
    for name, table in tables.items():
        table.write.format(fmt).save(f"{path.rstrip('/')}/version={version}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(time.time_ns(), version, fmt)], _LIST).coalesce(1).write.mode("append").json(_named(path))
    return version


def versions(spark: SparkSession, path: str) -> DataFrame:
    """(at, version, format) of what was published at ``path``; ``at`` in nanoseconds."""
    return spark.read.schema(_LIST).json(_named(path))


def published(spark: SparkSession, path: str, name: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A table of the version published last."""
    last = versions(spark, path).agg(F.max(F.struct("at", "version", "format")).alias("last")).first()["last"]
    if last is None:
        raise FileNotFoundError(f"nothing was published at {path}")
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.format(last["format"]).load(f"{path.rstrip('/')}/version={last['version']}/{name}")


def forget_older(spark: SparkSession, path: str, keep: int = 1) -> None:
    """Delete all but the last ``keep`` published versions, and what was written but never published.

    Not while another job publishes there or a reader still reads an old one.
    """
    names = [r["version"] for r in versions(spark, path).orderBy(F.desc("at")).limit(keep).collect()]
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for entry in files.listStatus(folder):
        name = entry.getPath().getName()
        if name.startswith("version=") and name.removeprefix("version=") not in names:
            files.delete(entry.getPath(), True)


def write_ranking(ranking: DataFrame, path: str) -> None:
    """The ranking, published as ``ranking``."""
    publish({"ranking": ranking}, path)


def write_season_tables(tables: dict[str, DataFrame], path: str) -> None:
    """All tables of a season page as JSON lines, published together."""
    publish(tables, path, "json")


def write_model_report(reports: dict[str, DataFrame], path: str) -> None:
    """Accuracy, class report and importances, published together."""
    publish(reports, path)


def write_results(results: DataFrame, path: str) -> None:
    """Race results laid out by season, so a season range reads only its folders."""
    results.write.mode("overwrite").partitionBy("season").parquet(path)
