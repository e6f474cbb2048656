"""Phrases against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from paceline.llm import collocations as col

SCHEMA = "doc_id bigint, text string, lang string, a bigint, score string, phrase string"


def brute(docs, least, inside, top):
    f, n = Counter(), Counter()
    for _, text, lang in docs:
        low = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und" if lang is None else lang] += len(w)
            for k in range(1, 5):
                f.update(((lang if lang is not None else "und"), *w[i : i + k]) for i in range(len(w) - k + 1))
    f = {p: a for p, a in f.items() if a >= least}
    rows = []
    for (lang, *p), a in f.items():
        if len(p) < 2:
            continue
        longer = [b for (other, *q), b in f.items() if other == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
        if any(100 * b >= inside * a for b in longer):
            continue
        cuts = [(f[lang, *p[:k]], f[lang, *p[k:]]) for k in range(1, len(p))]
        score, _, l, r = min((2_000_000 * a // (x + y), k, x, y) for k, (x, y) in enumerate(cuts))
        rows.append((lang, -score, -a, " ".join(p).encode(), l, r))
    out, rank = [], Counter()
    for lang, score, a, p, l, r in sorted(rows):
        rank[lang] += 1
        if rank[lang] <= top:
            out.append((lang, rank[lang], p.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def corpus(r, n):
    words = ["a", "B", "c", "é", "ß", "𝒳", "of", "the", " ", "x\x85"]
    signs = [" ", "  ", "\t", ". ", ",", "\n", "\x0b", " ", " ", " "]
    docs = [(i, "".join(r.choice(words[: r.randrange(3, 11)]) + r.choice(signs) for _ in range(r.randrange(0, 60))), r.choice(["en", None, "", "und"])) for i in range(n)]
    return docs + [(None, None, "en"), (7, "", None), (8, " . ,", "de")] + [(9, "One Very common PASSAGE of words", "en")] * 90


@pytest.mark.parametrize("suffixes", [1_000_000, 200, 30])
def test_equals_brute_force_whatever_the_routing(spark, monkeypatch, suffixes):
    docs = corpus(random.Random(3), 250)
    monkeypatch.setattr(col, "WORDS", 700)
    df = spark.createDataFrame([(*d, 1, "s", "p") for d in docs], SCHEMA).repartition(5)
    got = col.collocations(df, least=6, top=150, bins=64, suffixes=suffixes)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute(docs, 6, 80, 150)


def test_nothing_to_find(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert col.collocations(empty).collect() == []
    assert col.collocations(spark.createDataFrame([(1, None, None, 1, "s", "p"), (2, "a. b, c", "en", 1, "s", "p")], SCHEMA)).collect() == []


def test_one_long_text_of_one_word(spark):
    df = spark.createDataFrame([(1, "w " * 400_000, "en", 1, "s", "p")], SCHEMA)
    [row] = col.collocations(df).collect()
    assert row["phrase"] == "w w w w" and row["a"] == 399_997 and row["n"] == 400_000 and row["l"] == 400_000 and row["r"] == 399_998


@pytest.mark.parametrize("small", [1, 50, 10_000])
def test_equal_partitions(monkeypatch, small):
    monkeypatch.setattr(col, "SMALL", small)
    r = random.Random(5)
    rows = np.array([[r.randrange(1, 4), r.randrange(0, 4), 0] for _ in range(500)])
    rows[:, 2] = np.where(rows[:, 1] > 0, [r.randrange(0, 3) for _ in rows], 0)
    weights = np.array([r.randrange(1, 4) for _ in rows])
    got = {(d, *rows[k, :d]): c for d, k, c in col.equal_partitions(rows, weights, [5, 30, 40])}
    all_of = Counter()
    for row, w in zip(rows.tolist(), weights.tolist(), strict=True):
        for d in range(1, 4):
            if row[d - 1]:
                all_of[d, *row[:d]] += w
    assert got == {k: c for k, c in all_of.items() if c >= [5, 30, 40][k[0] - 1]}


def test_routes():
    route, cuts = col.routes(np.array([5, 5, 0, 30, 4, 7]), 10)
    assert route.tolist() == [0, 0, 0, 1, 2, 3] and cuts.tolist() == [1, 1, 1, 3, 1, 1]
