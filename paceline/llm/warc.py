"""WARC records in a content-addressed archive.

Payload bytes are stored once, under their SHA-256; record headers are stored
exactly, apart from them, with the digest they belong to.  A join of the two
gives the original records back, byte for byte, each checked against its digest.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.session import materialize, shared_dir

#: Payloads of fewer bytes are never revisits.
LEAST_BYTES = 0

#: The date of records whose pages have none.
DATE = "1970-01-01T00:00:00Z"

#: A payload is hot if more than LEAST_HOT records and a HOT-th of all records have it.
HOT, LEAST_HOT = 1000, 1000

_PAYLOADS, _HEADERS = "digest binary, payload binary, top bigint, copies bigint", "digest binary, length bigint, header string"

_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HEX32, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


@dataclass(frozen=True)
class Archive:
    """Where the tables of an archive lie, and into how many files by digest they are dealt."""

    path: str
    buckets: int

    @property
    def payloads(self) -> str:
        return f"{self.path}/payloads"

    @property
    def headers(self) -> str:
        return f"{self.path}/headers"

    @property
    def hot_headers(self) -> str:
        return f"{self.path}/hot_headers"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in upper-case base32: every 5 hexadecimal digits are 4 digits to the base 32."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), _HEX32, _BASE32)


def record_headers(rows: DataFrame) -> Column:
    """The header of each row's record, from page_id, url, digest (base 32), length and top.

    ``top``: the page whose record is the response for this payload.  Line ends
    in a url would break the header, so they are percent-encoded.
    """
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    record_id = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    revisit = F.col("revisit")
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    none = F.lit("")
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", record_id(F.col("page_id"))),
        line("WARC-Date", F.lit(DATE)),
        F.coalesce(line("WARC-Target-URI", url), none),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", record_id(F.col("top"))), line("WARC-Profile", F.lit(_PROFILE)))).otherwise(none),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("length").cast("string"))),
        F.lit("\r\n"),
    )


def _hot(spark: SparkSession, archive: Archive) -> DataFrame:
    """(digest, top, shares) of payloads that so many records have that one task should not get
    them all, and over how many tasks to deal them.

    Each has a HOT-th of all records at least, so they are HOT at most and may be sent to every task.
    """
    stored = spark.read.schema(_PAYLOADS).parquet(archive.payloads).select("digest", "top", "copies")
    records = stored.agg(F.sum("copies")).first()[0] or 0
    limit = max(LEAST_HOT, -(-records // HOT))
    return stored.filter(F.col("copies") > limit).select("digest", "top", F.ceil(F.col("copies") / limit).cast("int").alias("shares"))


def write_archive(pages: DataFrame, path: str | None = None, least_bytes: int = LEAST_BYTES) -> Archive:
    """Writes a record per row of ``pages`` (page_id, url, html) and returns where.

    Null html is an empty payload.  Of rows of equal payloads of ``least_bytes``
    or more, that with the largest page_id is the response and the others revisit
    it; rows that repeat that page_id are responses too, and rows without a
    page_id revisit it if there is one.  ``path``: a folder all executors share.

    Payload bytes cross the network once, to meet their copies.  Both tables stay
    dealt by digest, so that reading the records back moves no payload again; the
    headers of hot payloads are kept apart.
    """
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark).rstrip('/')}/paceline/{spark.sparkContext.applicationId}/warc-{uuid.uuid4().hex}"
    archive = Archive(path, int(spark.conf.get("spark.sql.shuffle.partitions")))
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("payload", 256)))
    # Copies meet as partial groups, one row per payload and task.
    once = rows.groupBy("digest").agg(F.first("payload").alias("payload"), F.max("page_id").alias("top"), F.count(F.lit(1)).alias("copies"))
    _write_dealt(once, archive.payloads, archive.buckets)

    facts = rows.select("page_id", "url", "digest", base32_sha1(F.col("payload")).alias("sha1"), F.length("payload").cast("bigint").alias("length"))
    revisit = (F.col("length") >= least_bytes) & F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top"))
    hot = materialize(_hot(spark, archive), "hot")
    known = _dealt(spark, archive.payloads, _PAYLOADS, archive.buckets).select("digest", "top")
    made = lambda t: t.withColumn("revisit", revisit).select("digest", "length", record_headers(t.withColumn("revisit", revisit)).alias("header"))
    crowd = F.broadcast(hot.select("digest", "top"))
    made(facts.join(crowd, "digest")).write.option("compression", "zstd").parquet(archive.hot_headers)
    _write_dealt(made(facts.join(crowd, "digest", "left_anti").join(known.hint("merge"), "digest")), archive.headers, archive.buckets)
    return archive


def _write_dealt(df: DataFrame, path: str, buckets: int) -> None:
    """Writes ``df``, dealt by digest; the table's name lives in this session only, the files stay."""
    spark, name = df.sparkSession, f"warc_{uuid.uuid4().hex}"
    writer = df.write.format("parquet").option("path", path).option("compression", "zstd")
    writer.bucketBy(buckets, "digest").saveAsTable(name)
    spark.sql(f"drop table {name}")


def _dealt(spark: SparkSession, path: str, schema: str, buckets: int) -> DataFrame:
    """A table that ``_write_dealt`` wrote, its layout known to the planner."""
    name = f"warc_{uuid.uuid4().hex}"
    spark.sql(f"create table {name} ({schema}) using parquet clustered by (digest) into {buckets} buckets location '{path}'")
    table = spark.table(name)
    spark.sql(f"drop table {name}")
    return table


def read_archive(spark: SparkSession, archive: Archive) -> DataFrame:
    """Every record: header (string), payload (bytes of the page it stands for), record (the bytes of the record).

    A payload that does not have the digest it is filed under, or the length its
    record was written with, fails the read.
    """
    headers = _dealt(spark, archive.headers, _HEADERS, archive.buckets)
    payloads = _dealt(spark, archive.payloads, _PAYLOADS, archive.buckets).select("digest", "payload")
    cold = headers.join(payloads.hint("merge"), "digest", "left")
    # Records of a hot payload are dealt over as many tasks as they would fill.
    shares = F.broadcast(_hot(spark, archive).select("digest", "shares"))
    stored = spark.read.schema(_PAYLOADS).parquet(archive.payloads).select("digest", "payload").join(shares, "digest")
    copied = stored.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")
    crowd = spark.read.schema(_HEADERS).parquet(archive.hot_headers).join(shares, "digest", "left")
    crowd = crowd.withColumn("share", F.pmod(F.xxhash64("header"), F.col("shares")).cast("int")).drop("shares")
    joined = cold.unionByName(crowd.join(copied.hint("merge"), ["digest", "share"], "left").drop("share"))
    sound = F.coalesce((F.unhex(F.sha2("payload", 256)) == F.col("digest")) & (F.length("payload") == F.col("length")), F.lit(False))
    checked = F.when(sound, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.hex("digest"))).cast("binary"))
    block = F.when(F.col("header").startswith("WARC/1.1\r\nWARC-Type: revisit"), F.lit(b"")).otherwise(F.col("payload"))
    return joined.withColumn("payload", checked).select(
        "header", "payload", F.concat(F.encode("header", "UTF-8"), block, F.lit(b"\r\n\r\n")).alias("record")
    )


def header_field(header: Column, name: str) -> Column:
    """A field of a record header, null where it is missing."""
    found = F.regexp_extract(header, rf"\r\n{name}: ([^\r\n]*)", 1)
    return F.when(header.contains(f"\r\n{name}: "), found)


def describe(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to, read from the records.

    The digest is computed from the payload again; a header that says otherwise fails the read.
    """
    page = lambda name: F.regexp_extract(header_field(F.col("header"), name), r"<urn:page:(-?\d+)>", 1)
    number = lambda c: F.when(F.length(c) > 0, c).cast("bigint")
    digest = base32_sha1(F.col("payload"))
    said = header_field(F.col("header"), "WARC-Payload-Digest")
    return records.select(
        number(page("WARC-Record-ID")).alias("page_id"),
        F.length("payload").cast("bigint").alias("payload_bytes"),
        F.when(F.concat(F.lit("sha1:"), digest) == said, digest).otherwise(F.raise_error(F.lit("digests differ")).cast("string")).alias("payload_digest"),
        header_field(F.col("header"), "WARC-Type").alias("record_type"),
        number(page("WARC-Refers-To")).alias("refers_to"),
    )


def export_files(records: DataFrame, path: str, records_per_file: int = 20_000) -> None:
    """Writes the records as plain ``.warc`` text files of bounded size, end to end as the format asks.

    Payloads must be UTF-8, as those of pages are.
    """
    text = F.decode(F.expr("substring(record, 1, length(record) - 4)"), "UTF-8")
    writer = records.select(text.alias("value")).write.option("lineSep", "\r\n\r\n")
    writer.option("maxRecordsPerFile", records_per_file).text(path)


def import_files(spark: SparkSession, path: str) -> DataFrame:
    """header and payload of every record of plain WARC files below ``path``, cut by Content-Length."""

    def rows(batches):
        for batch in batches:
            for data in batch.column("content"):
                raw, at, headers, payloads = data.as_py(), 0, [], []
                while (end := raw.find(b"\r\n\r\n", at)) >= 0:
                    head = raw[at : end + 4]
                    fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:] if b": " in x)
                    size = int(fields[b"Content-Length"])
                    headers.append(head.decode())
                    payloads.append(raw[end + 4 : end + 4 + size])
                    at = end + 8 + size
                yield pa.RecordBatch.from_arrays([pa.array(headers, pa.string()), pa.array(payloads, pa.binary())], ["header", "payload"])

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(rows, "header string, payload binary")
