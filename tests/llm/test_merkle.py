"""Trees and proofs against plain recomputation."""

import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from paceline.llm import merkle

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, tree int, place string, hash int, part int, level int"


def h(text):
    return sha256(text.encode()).hexdigest()


def leaf(doc_id, text, lang, source, n):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n, text)))


def climb(nodes, arity):
    """(root, siblings with their side of each node) of a list of nodes."""
    ways = [[] for _ in nodes]
    under = [[k] for k in range(len(nodes))]
    while len(nodes) > 1:
        up, over = [], []
        for first in range(0, len(nodes), arity):
            run = nodes[first : first + arity]
            for k in range(len(run)):
                for w in under[first + k]:
                    ways[w].append((run[:k], run[k + 1 :]))
            up.append(h("".join(run)))
            over.append([w for u in under[first : first + arity] for w in u])
        nodes, under = up, over
    return nodes[0], ways


def brute(docs, arity=2):
    langs = sorted({d[2] for d in docs}, key=lambda x: (x is not None, (x or "").encode()))
    parts = []
    for lang in langs:
        rows = sorted((d for d in docs if d[2] == lang), key=lambda d: (d[0] is not None, d[0] or 0, leaf(*d)))
        parts.append((rows, *climb([leaf(*d) for d in rows], arity)))
    root, tops = climb([p[1] for p in parts], arity)
    out = []
    for (rows, subroot, ways), top in zip(parts, tops, strict=True):
        for d, way in zip(rows, ways, strict=True):
            way = way + top
            n = d[4] + 1 if d[4] is not None and d[0] is not None and zlib.crc32(str(d[0]).encode()) % 7 == 0 else d[4]
            at = leaf(*d[:4], n)
            for before, after in way:
                at = h("".join([*before, at, *after]))
            said = h("".join(s for before, after in way for s in (*before, *after)))
            out.append((d[0], leaf(*d), subroot, root, said, at, at == root))
    return sorted(out, key=str)


def made(spark, docs, **kw):
    df = spark.createDataFrame([(*d, 1, "p", 2, 3, 4) for d in docs], SCHEMA).repartition(3)
    return sorted(map(tuple, merkle.audit(df, **kw).collect()), key=str)


def corpus(r, n, langs=("en", "de", None, "", "ü")):
    return [(i, r.choice([None, "", "tëxt 𝒳", "x" * 50]), r.choice(langs), r.choice([None, "web"]), r.choice([None, 0, -3, i])) for i in range(n)]


@pytest.mark.parametrize(("arity", "wide", "part"), [(2, 4, 8), (2, 1 << 14, 1 << 14), (3, 9, 5), (2, 64, 7)])
def test_equals_recomputation(spark, arity, wide, part):
    docs = corpus(random.Random(1), 300) + [(1000, None, "only one", None, 5)]
    docs += [(7, "other text", "en", None, 3), (7, "other text", "en", None, 3), (None, None, None, None, None), (None, "t", "en", "s", 2**63 - 1)]
    assert made(spark, docs, arity=arity, wide=wide, part=part) == brute(docs, arity)


def test_many_equal_rows_and_one_language(spark):
    docs = [(14, "same", "en", "s", 4)] * 500 + [(i, "t", "en", "s", 1) for i in range(20)]
    assert made(spark, docs, wide=16, part=32) == brute(docs)


def test_few_rows(spark):
    assert made(spark, []) == []
    for n in (1, 2, 3):
        docs = corpus(random.Random(n), n, ("en",))
        assert made(spark, docs) == brute(docs)
    docs = [(i, "t", f"lang{i}", None, 1) for i in range(23)]
    assert made(spark, docs, wide=4, part=4) == brute(docs)


def test_a_multiproof_is_the_least(spark):
    r = random.Random(5)
    for arity in (2, 3):
        for n in range(1, 40):
            sizes = merkle.levels(n, arity)
            known = r.sample(range(n), r.randrange(1, n + 1))
            # A leaf gives its path; of what is left, a node is needed if its parent is on a path.
            paths = [{k // arity**level for k in known} for level in range(len(sizes))]
            needed = {(lv, c) for lv in range(len(sizes) - 1) for c in range(sizes[lv]) if c not in paths[lv] and c // arity in paths[lv + 1]}
            assert set(merkle.missing(known, sizes, arity)) == needed and len(merkle.missing(known, sizes, arity)) == len(needed)


def test_a_partition_fetches_few_nodes():
    sizes = merkle.levels(1 << 20)
    assert len(merkle.missing(range(1 << 14, 1 << 15), sizes)) == 6
    assert len(merkle.missing(range(100, 100 + (1 << 14)), sizes)) <= 2 * len(sizes)


def test_wanted_nodes_are_copied(spark, monkeypatch):
    monkeypatch.setattr(merkle, "FETCHERS", 2)
    docs = corpus(random.Random(9), 200, ("en", "de"))
    assert made(spark, docs, wide=8, part=4) == brute(docs)


def test_places(spark):
    rows = spark.range(1000).select(F.pmod("id", F.lit(3)).alias("g"), (F.lit(1000) - F.col("id")).alias("x")).repartition(7)
    got = {}
    for row in merkle.numbered(rows, "g", ["x"], "t").collect():
        got.setdefault(row["g"], []).append((row["place"], row["x"]))
    for pairs in got.values():
        assert [p for p, _ in sorted(pairs)] == list(range(len(pairs)))
        assert [x for _, x in sorted(pairs)] == sorted(x for _, x in pairs)
