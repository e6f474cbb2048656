"""The archive: exact round trips, one copy of each payload, and what is read back."""

import base64
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from paceline.llm import warc

PAGES = [
    (1, "http://a/", "<p>x</p>"),
    (2, None, "<p>x</p>"),
    (3, "http://b/\r\nX: y", "<p>x</p>"),
    (4, "http://c/", None),
    (5, "http://d/", ""),
    (6, "http://e/é", "ü\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" + "z" * 100_000),
    (6, "http://e/é", "ü\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" + "z" * 100_000),
    (None, "http://f/", "alone"),
    (None, "http://g/", "<p>x</p>"),
    (-7, "http://h/", "negative"),
]


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 as digest", "2 as length")


def brute(rows):
    top = {}
    for i, _, h in rows:
        h = h or ""
        if i is not None:
            top[h] = max(top.get(h, i), i)
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        t = top.get(h or "")
        revisit = t is not None and i != t
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        out.append((i, len(raw), digest, "revisit" if revisit else "response", t if revisit else None))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(map(tuple, df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


def test_round_trip(spark):
    archive = warc.write_archive(pages_of(spark, PAGES))
    records = warc.read_archive(spark, archive)
    assert rows_of(warc.describe(records)) == brute(PAGES)
    assert spark.read.parquet(archive.payloads).count() == len({h or "" for _, _, h in PAGES})
    for r in records.collect():
        block = b"" if "WARC-Type: revisit" in r["header"][:40] else bytes(r["payload"])
        assert bytes(r["record"]) == r["header"].encode() + block + b"\r\n\r\n"
        assert f"Content-Length: {len(block)}\r\n" in r["header"]
        assert len(re.findall("\r\nX: y", r["header"])) == 0


def test_least_bytes(spark):
    got = warc.describe(warc.read_archive(spark, warc.write_archive(pages_of(spark, PAGES), least_bytes=9)))
    types = {(r["page_id"], r["record_type"]) for r in got.collect()}
    assert (1, "response") in types and (6, "response") in types and (5, "response") in types


def test_empty_table(spark):
    assert warc.read_archive(spark, warc.write_archive(pages_of(spark, []))).collect() == []


def test_damage_is_noticed(spark, tmp_path):
    archive = warc.write_archive(pages_of(spark, PAGES))
    bad = warc.Archive(str(tmp_path), 3)
    warc._write_dealt(spark.read.parquet(archive.headers), bad.headers, 3)
    spark.read.parquet(archive.hot_headers).write.parquet(bad.hot_headers)
    warc._write_dealt(spark.read.parquet(archive.payloads).withColumn("payload", F.concat("payload", F.lit(b"!"))), bad.payloads, 3)
    with pytest.raises(Exception, match="damaged payload"):
        warc.read_archive(spark, bad).collect()


def test_hot_payloads_are_spread_and_no_payload_moves_again(spark, monkeypatch):
    monkeypatch.setattr(warc, "LEAST_HOT", 5)
    monkeypatch.setattr(warc, "HOT", 20)
    rows = [(i, f"http://x/{i}", "hot" if i % 3 else f"page {i}") for i in range(200)] + [(None, None, "hot"), (300, "u", "warm")] + [(301, "u", "warm")] * 4
    archive = warc.write_archive(pages_of(spark, rows))
    assert spark.read.parquet(archive.hot_headers).count() == sum(h == "hot" for _, _, h in rows)
    records = warc.read_archive(spark, archive)
    assert rows_of(warc.describe(records)) == brute(rows)
    # The tables dealt by digest meet where they lie; only the hot payloads' shares move.
    plan = records._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"Exchange hashpartitioning\(digest#\d+, share#\d+", plan)
    assert not re.search(r"Exchange hashpartitioning\(digest#\d+, \d+\)", plan)


def test_files(spark, tmp_path):
    records = warc.read_archive(spark, warc.write_archive(pages_of(spark, PAGES)))
    warc.export_files(records, f"{tmp_path}/files", records_per_file=3)
    back = warc.import_files(spark, f"{tmp_path}/files/*.txt")
    want = records.withColumn("block", F.when(F.col("header").contains("WARC-Type: revisit"), F.lit(b"")).otherwise(F.col("payload")))
    assert sorted((r[0], bytes(r[1])) for r in back.select("header", "payload").collect()) == sorted(
        (r[0], bytes(r[1])) for r in want.select("header", "block").collect()
    )
