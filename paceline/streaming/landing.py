"""Incremental ingest: only documents that arrived since the last run.

A run reads what is new in the landing folder, adds its rows to a table, and stops;
its progress is kept in ``progress``.  It replaces fetching every season again each
time.  Beside the table lie the captures it came from, the rows that lack what they
must have, and the documents that could not be read.

Each batch owns a folder in each of these and writes it whole, so a batch that is
run again after a failure adds nothing.  What newer captures replace stays in the
files and is left out when read (``ingested``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from paceline.sources.documents import (
    CAPTURED,
    accepted,
    current_rows,
    document_schema,
    flatten,
    manifest,
    newest,
    quarantine,
    readable,
    rejected,
    stream_documents,
)


def quarantine_of(table: str) -> str:
    """Where the unreadable documents of a table are kept."""
    return f"{table.rstrip('/')}_quarantine"


def rejects_of(table: str) -> str:
    """Where the rows that lack what they must have are kept, with the reasons."""
    return f"{table.rstrip('/')}_rejects"


def captures_of(table: str) -> str:
    """Where the captures are listed that a table's rows come from."""
    return f"{table.rstrip('/')}_captures"


def ingest_new(spark: SparkSession, landing: str, kind: str, table: str, progress: str) -> StreamingQuery:
    """Add a kind's new documents to the Parquet table at ``table``.

    Returns the running query; it ends by itself once all is read.
    """

    def store(batch: DataFrame, number: int) -> None:
        documents = readable(batch, kind)
        rows = flatten(documents, kind)
        parts = {
            table.rstrip("/"): accepted(rows, kind),
            rejects_of(table): rejected(rows, kind),
            captures_of(table): manifest(documents, kind),
            quarantine_of(table): quarantine(batch, kind),
        }
        for path, part in parts.items():
            part.write.mode("overwrite").parquet(f"{path}/batch={number}")

    documents = stream_documents(spark, landing, kind)
    writer = documents.writeStream.trigger(availableNow=True).option("checkpointLocation", progress)
    return writer.foreachBatch(store).start()


def _empty(spark: SparkSession, kind: str) -> DataFrame:
    """No documents of a kind, with their capture, for the schemas of what is made of them."""
    fields = T.StructType().add("issued", "date").add("at", "timestamp").add("capture", "string")
    return spark.createDataFrame([], document_schema(kind).add(CAPTURED, fields))


def ingested(spark: SparkSession, table: str, kind: str) -> DataFrame:
    """The table as of now: the rows of each request's newest capture, the newest of each key."""
    documents = _empty(spark, kind)
    rows = spark.read.schema(flatten(documents, kind).schema).parquet(table)
    captures = spark.read.schema(manifest(documents, kind).schema).parquet(captures_of(table))
    return newest(current_rows(rows, kind, captures), kind)


def compact(spark: SparkSession, table: str, kind: str, target: str) -> None:
    """Write the table as of now to ``target``, without what newer captures replaced, by season if it has one."""
    rows = ingested(spark, table, kind)
    writer = rows.write.partitionBy("season") if "season" in rows.columns else rows.write
    writer.parquet(target)
