"""The pipeline on a small fixture with a case for every stage, and the queries' SQL twins."""

import random
import re
import zlib

import pytest
from compare import connect, difference

import corpus_pipeline
from paceline.llm import oracles, queries

TABLES = {"documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
          "labels": "doc_id bigint, quality int, toxic int", "benchmark": "item_id bigint, text string"}


def words(r, n):
    return " ".join("".join(r.choice(["ba", "ko", "ri", "ten", "lu", "sa"]) for _ in range(r.randrange(2, 5))) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r, path = random.Random(4), str(tmp_path_factory.mktemp("sf"))
    texts = {i: words(r, 60) for i in range(200)}
    for i in range(0, 200, 4):
        texts[i] = words(r, 30) + " what a moron and idiot you are " + words(r, 30)
    item = words(r, 14)
    texts[301] = texts[1]
    texts[302] = texts[2].rsplit(" ", 1)[0] + " changed"
    texts[303] = words(r, 20) + " " + item + " " + words(r, 20)
    texts[304] = "mail me at some.one_3@mail7.example.com " + words(r, 30)
    texts[305] = None
    texts[306] = ""
    rows = {
        "documents": [(i, t, "en", "s", len(t or "")) for i, t in texts.items()],
        "labels": [(i, 1, int(i % 4 == 0)) for i in range(200)],
        "benchmark": [(1, item), (2, None)],
    }
    for name, schema in TABLES.items():
        spark.createDataFrame(rows[name], schema).write.parquet(f"{path}/{name}.parquet")
    return path, texts


def test_stages(spark, folder):
    path, texts = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, kept = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = spark.createDataFrame(stage(spark, docs, path).toArrow())
        if k < 4:
            assert docs.columns == columns
            kept.append({row["doc_id"]: row["text"] for row in docs.collect()})
    toxic = {i for i in range(0, 200, 4)}
    assert set(kept[0]) == set(texts) - toxic
    assert set(kept[1]) == set(kept[0]) - {301, 302}
    assert set(kept[2]) == set(kept[1]) - {303}
    assert set(kept[3]) == set(kept[2])
    assert {i for i in kept[3] if kept[3][i] != kept[2][i]} == {304}
    assert not re.search("some.one_3", kept[3][304])
    assert {row["doc_id"] for row in docs.collect()} == set(kept[3])


def test_run_gives_the_last_stage(spark, folder):
    path, texts = folder
    rows = corpus_pipeline.run(spark, path).collect()
    ids = {row["doc_id"] for row in rows}
    assert not ids & ({301, 302, 303} | set(range(0, 200, 4))) and {304, 305, 306} <= ids
    assert all(row["ids_crc32"] == zlib.crc32(b"\x01\0\0\0") for row in rows if row["doc_id"] in (305, 306))


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    assert difference(queries.QUERIES[name](spark, sf_dir), connect(sf_dir), oracles.ORACLES[name]) is None


def test_queries_are_named_after_the_operators():
    assert [int(n[2:].split("_")[0]) for n in queries.QUERIES] == list(range(1, 14))
