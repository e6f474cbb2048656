"""Toxicity: features by a loop, learning on clear cases, and the effect of the swaps."""

import numpy as np
from pyspark.sql import functions as F

from paceline.llm import langid, queries, toxicity
from paceline.llm.common import ALNUM, hash_terms

LABELS = "doc_id bigint, toxic int"


def corpus(n=120):
    texts, labels = [], []
    for i in range(n):
        bad = i % 3 == 0
        # A group is named mostly in the toxic texts: a shortcut that must not be learnt.
        group = "muslims" if bad and i % 2 == 0 else ("people" if i % 5 else "christians")
        texts.append((i, f"some plain words about {group} number{i % 7}. " + ("what a moron and idiot" if bad else "a fine day it is")))
        labels.append((i, int(bad)))
    return texts, labels


def test_features_of_words_and_beginnings():
    raw = "Moronic it".encode()
    got, owner = toxicity.features_of(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    assert len(got) == 2 + 3 and set(owner) == {0}
    assert set(hash_terms(["moronic", "it"], ALNUM)) <= set(got)
    other, _ = toxicity.features_of(np.frombuffer(b"moronism", np.uint8), np.array([0, 8]))
    assert len(set(got) & set(other)) == 3  # moro, moron, moroni


def test_swaps_take_the_score_off_a_mention(spark, frame, monkeypatch):
    texts, labels = corpus()
    table = spark.createDataFrame(labels, LABELS)
    ask = frame([(1, "people number3"), (2, "muslims number3"), (3, "christians number3"), (4, "what a moron"), (5, "moronic idiots")])

    def scores():
        c = toxicity.fit(frame(texts), table)
        return {r["doc_id"]: r["score"] for r in toxicity.score(ask, c).collect()}

    with_ = scores()
    monkeypatch.setattr(toxicity, "COUNTERFACTUAL", 0.0)
    monkeypatch.setattr(toxicity.fit_weights, "__defaults__", (0.0,))
    without = scores()
    assert abs(with_[2] - with_[3]) < 0.5 * abs(without[2] - without[3])
    assert with_[4] > 0.5 > with_[1]


def test_the_query_learns_from_counterfactuals_in_four_languages(spark, sf_dir, frame):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").filter(~langid.held_out())
    c = toxicity.fit(docs, labels)
    assert c.swaps > 100_000
    # Neutral mentions score alike, and near a sentence that names no group.
    frames = ["the {} came to the meeting today", "die {} kamen heute zum treffen", "les {} sont venus au rendez-vous", "los {} llegaron hoy a la cita"]
    asked = [(i, f.format(t)) for i, (f, t) in enumerate((f, t) for f in frames for t in ("", *toxicity.TERMS))]
    got = [r["score"] for r in toxicity.score(frame(asked), c).orderBy("doc_id").collect()]
    each = len(toxicity.TERMS) + 1
    for k in range(4):
        part = got[k * each : (k + 1) * each]
        assert max(part) - min(part) <= 0.05


def test_penalty_gradients(spark):
    r = np.random.default_rng(1)
    kinds = [[np.array([0]), np.array([1, 2]), np.array([3])], [np.array([4]), np.array([5])]]
    owner, column = np.array([0, 0, 1, 1, 2]), np.array([0, 6, 7, 5, 6])
    c = toxicity.Counterfactuals(3, owner, column, kinds)
    w, b = r.normal(size=8), 0.3
    value, gw, gb = c.penalty(w, b)
    sigma = lambda z: 1 / (1 + np.exp(-z))
    total = 0.0
    for s in range(3):
        for kind in kinds:
            used = set(np.concatenate(kind).tolist())
            rest = b + sum(w[f] for o, f in zip(owner, column, strict=True) if o == s and f not in used)
            p = [sigma(rest + w[t].sum()) for t in kind]
            total += sum((x - y) ** 2 for i, x in enumerate(p) for y in p[:i])
    assert np.isclose(value, total / c.pairs()) and c.pairs() == 3 * 4
    for k in range(8):
        e = np.zeros(8)
        e[k] = 1e-6
        assert np.isclose((c.penalty(w + e, b)[0] - c.penalty(w - e, b)[0]) / 2e-6, gw[k], atol=1e-6)
    assert np.isclose((c.penalty(w, b + 1e-6)[0] - c.penalty(w, b - 1e-6)[0]) / 2e-6, gb, atol=1e-6)


def test_held_out_quality(spark, sf_dir):
    rows = queries.toxicity_scores(spark, sf_dir)
    assert set(rows.columns) == {"doc_id", "held_out", "score", "predicted"}
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    got = rows.join(labels, "doc_id").filter("held_out")
    right = got.agg(F.avg((F.col("toxic") == F.col("predicted")).cast("int"))).first()[0]
    assert right >= 0.85
    assert rows.filter("score < 0 or score > 1 or (score >= 0.5) <> (predicted = 1)").isEmpty()


def test_edge_cases(spark, frame):
    texts, labels = corpus(60)
    table = spark.createDataFrame(labels + [(1, None), (2, 7), (None, 1)], LABELS)
    c = toxicity.fit(frame(texts + [(500, None), (None, "x")]), table)
    cases = [(1, None), (2, ""), (3, "a moron " * 30_000), (3, "a moron"), (None, "moron")]
    df = frame(cases).selectExpr("*", "'?' as score", "'?' as predicted")
    got = toxicity.score(df, c).collect()
    by = {(r["doc_id"], r["text"]): r["score"] for r in got}
    assert len(got) == 5 and by[1, None] == by[2, ""] < 0.5
    assert toxicity.score(frame([]), c).collect() == []
    one = toxicity.fit(frame(texts), spark.createDataFrame([(1, 0), (2, 0)], LABELS))
    assert {r["predicted"] for r in toxicity.score(frame(cases), one).collect()} == {0}
    nothing = toxicity.fit(frame([]), spark.createDataFrame([], LABELS))
    assert {r["score"] for r in toxicity.score(frame(cases), nothing).collect()} == {0.5}
