"""The byte network: its gradients, its fast form, and held-out accuracy."""

import numpy as np
from pyspark.sql import functions as F

from paceline.llm import langid, queries


def small():
    r = np.random.default_rng(1)
    net = langid.Network.random(["a", "b", "c"])
    x = r.integers(0, 256, (6, 40)).astype(np.uint8)
    return net, x, r.integers(0, 3, 6)


def test_gradients():
    net, x, y = small()
    net = langid.Network(net.languages, *(
        [p.astype(np.float64) for p in v] if isinstance(v, list) else v.astype(np.float64)
        for v in (net.bytes_, net.filters, net.bias, net.out, net.out_bias)
    ))
    _, gradients = net.step(x, y)
    r = np.random.default_rng(2)
    for p, g in zip(net.parameters(), gradients, strict=True):
        for at in r.integers(0, p.size, 12):
            old, e = p.flat[at], 1e-5
            p.flat[at] = old + e
            up, _ = net.step(x, y)
            p.flat[at] = old - e
            down, _ = net.step(x, y)
            p.flat[at] = old
            assert abs((up - down) / (2 * e) - g.flat[at]) < 1e-4


def test_tables_compute_the_same_function():
    net, x, _ = small()
    e = net.bytes_[x]
    hidden = []
    for w, f, b in zip(langid.WIDTHS, net.filters, net.bias, strict=True):
        spans = np.concatenate([e[:, j : 40 - w + 1 + j] for j in range(w)], axis=2)
        hidden.append((spans @ f + b).max(axis=1))
    z = np.maximum(np.concatenate(hidden, axis=1), 0) @ net.out + net.out_bias
    p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    assert np.allclose(np.exp(net.log_odds(x.T, net.tables())), p, atol=1e-4)


def test_windows_cover_whole_texts():
    raw = np.frombuffer(b"abcdefghij" + b"xyz" + b"", np.uint8)
    w, owner = langid.windows_of(raw, np.array([0, 10, 13, 13]), 4)
    assert [bytes(c) for c in w.T] == [b"abcd", b"efgh", b"ij\0\0", b"xyz\0"]
    assert owner.tolist() == [0, 0, 0, 1]


def test_held_out_accuracy(spark, sf_dir):
    rows = queries.languages(spark, sf_dir)
    assert set(rows.columns) == {"doc_id", "held_out", "lang_pred", "score"}
    truth = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    got = rows.join(truth, "doc_id").filter("held_out and lang_pred <> 'und'")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.93
    assert rows.filter("score < 0 or score > 1").isEmpty()


def test_edge_cases(frame):
    net = langid.fit(frame([(1, "the cat and the dog " * 5), (2, "the bird")]).unionByName(
        frame([(3, "der hund und die katze " * 5)]).withColumn("lang", F.lit("de"))
    ))
    cases = [(1, None), (2, ""), (3, "12 34 !? ²"), (4, "the dog"), (5, "x" * 200_000), (4, "the dog"), (None, "é")]
    df = frame(cases).selectExpr("*", "'?' as lang_pred", "'?' as score")
    got = langid.identify(df, net).collect()
    assert len(got) == len(cases)
    assert all((r["lang_pred"] == "und") == (r["doc_id"] in (1, 2, 3)) for r in got)
    assert all(0 <= r["score"] <= 1 for r in got)
    assert langid.identify(frame([]), net).collect() == []
    none = langid.fit(frame([(1, None), (2, "12")]))
    assert none is None
    assert {r["lang_pred"] for r in langid.identify(frame(cases), none).collect()} == {"und"}


def test_a_rare_language_is_learnt(spark):
    import random

    r = random.Random(6)
    common, rare = ["the", "and", "house", "river", "light", "stone"], ["ŵyth", "llŷn", "ddŵr", "gŵyl", "tŷ", "môr"]
    say = lambda words: " ".join(r.choice(words) for _ in range(40))
    rows = [(i, say(rare if i % 250 == 0 else common), "cy" if i % 250 == 0 else "en") for i in range(10_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    net = langid.fit(df)
    assert net.languages == ["cy", "en"]
    asked = [(1, say(rare), None), (2, say(common), None), (3, (say(rare) + " ") * 12_000, None), (4, (say(common) + " ") * 12_000, None)]
    got = langid.identify(spark.createDataFrame(asked, "doc_id bigint, text string, lang string"), net).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in got} == {1: "cy", 2: "en", 3: "cy", 4: "en"}


def test_held_out_rows_are_not_learnt_from(frame):
    import zlib

    got = frame([(i, "x") for i in range(50)] + [(None, "x")]).select("doc_id", langid.held_out().alias("h")).collect()
    assert all(r["h"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
