"""Near-duplicate groups against all pairs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from paceline.llm import neardup
from paceline.llm.components import connected_components


def shingles(text, width):
    low = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0d]+", low)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1)))


def components(docs, width, percent):
    sets = [(i, shingles(t, width)) for i, t in docs]
    up = {i: i for i, _ in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (a, s) in enumerate(sets):
        for b, t in sets[:k]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return sorted((i, len(s), root(i), root(i) == i) for i, s in sets)


def result(df):
    return sorted(map(tuple, df.select("doc_id", "n_shingles", "component_id", "kept").collect()))


def family(r, n, words=150, edits=12):
    """A text and edited copies of copies."""
    vocabulary = [f"w{i}" for i in range(400)]
    rows = [[r.choice(vocabulary) for _ in range(words)]]
    for _ in range(n - 1):
        w = list(r.choice(rows[-20:]))
        for _ in range(r.randrange(1, edits)):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        rows.append(w)
    return [" ".join(w) for w in rows]


def test_edge_cases(frame):
    docs = [
        (1, None), (2, ""), (3, " \n "), (4, "one"), (5, "ONE"), (6, "one two"), (7, "one  two"), (8, "two one"),
        (9, "a b c d e f g h i j k l"), (10, "a b c d e f g h i j k"), (11, "long " * 30_000), (12, "long " * 20_000),
    ]
    df = frame(docs).selectExpr("*", "1 as component_id", "2 as row_key", "3 as n_shingles")
    assert result(neardup.near_duplicates(df, 2)) == components(docs, 2, 80)
    assert result(neardup.near_duplicates(frame([]))) == []


def test_rows_without_or_with_repeated_ids(frame):
    got = neardup.near_duplicates(frame([(None, "a b c"), (1, "a b c"), (1, "a b c"), (2, "a b c")]), 2).collect()
    assert sorted(map(tuple, got), key=str) == sorted(
        [(None, 2, None, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False)], key=str
    )


@pytest.mark.parametrize("width", [2, 5])
def test_a_crowded_family(frame, width):
    r = random.Random(width)
    docs = list(enumerate(family(r, 300) + family(r, 3) + family(r, 2, 8, 3), start=1))
    assert result(neardup.near_duplicates(frame(docs), width)) == components(docs, width, 80)


def test_given_documents(frame, texts):
    docs = [(i, t) for i, t in texts]
    assert result(neardup.near_duplicates(frame(docs))) == components(docs, 5, 80)
    kept = neardup.deduplicate(frame(docs))
    assert kept.columns == frame([]).columns
    assert sorted(r[0] for r in kept.collect()) == [i for i, _, _, k in components(docs, 5, 80) if k]


def test_candidates_do_not_grow_with_the_square_of_a_group(spark, frame):
    r = random.Random(9)
    docs = list(enumerate(family(r, 400, edits=3), start=1))
    signed = neardup.sign(frame(docs), 2).withColumn("id", F.col("doc_id")).filter("digest is not null")
    pairs = neardup.neighbours(neardup.forest_rows(signed), 80)
    assert pairs.count() <= 400 * neardup.TREES * neardup.REACH / 2


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 3), (200, 200)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()))
    assert got == {i: 0 for i in range(61)} | {100 + i: 100 for i in range(40)}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def merged(docs, width, percent):
    """The rows of ``components``, where those of one id are one document."""
    rows = components([((i, k), t) for k, (i, t) in enumerate(docs)], width, percent)
    group = {}

    def root(x):
        while group.setdefault(x, x) != x:
            x = group[x]
        return x

    for (i, _), _, (j, _), _ in rows:
        x, y = sorted((root(i), root(j)))
        group[y] = x
    return sorted((i, n, root(i), root(i) == i) for (i, _), n, _, _ in rows)


def test_a_repeated_id_with_other_texts(spark, frame):
    r = random.Random(4)
    one, two, three, four = (family(r, 6, 60, 4) for _ in range(4))
    docs = [(i, t) for i, t in enumerate(one + two, start=10)]
    # 50: a text near each family, one of its own, null and empty; 51 to 53: null or empty beside a text.
    docs += [(50, one[3] + " x"), (50, two[2] + " y"), (50, three[0]), (50, None), (50, ""), (60, three[1])]
    docs += [(51, None), (51, three[2]), (52, ""), (52, four[0]), (53, four[1]), (53, None), (54, None), (54, "")]
    # Two texts with the same smallest id; each has its own near copy.
    docs += [(3, four[2]), (3, "p q r s t u v w"), (70, four[2]), (71, "p q r s t u v w"), (4, None), (4, "p q r s t u v w x")]
    for order in (docs, docs[::-1], r.sample(docs, len(docs))):
        df = frame(order).repartition(3)
        assert result(neardup.near_duplicates(df, 2)) == merged(order, 2, 80)


def test_neighbours_across_the_borders_of_partitions(spark, monkeypatch):
    # All rows of one tree share their first hashes: every pair up to REACH apart must come.
    n = 400
    schema = "key bigint, rest bigint, id bigint, size bigint, s0 bigint, s1 bigint"
    forest = spark.createDataFrame([(1, i // 3, i, 10, 0, 0) for i in range(n)] + [(2, 0, 5000, 10, 0, 0)], schema)
    got = {tuple(r) for r in neardup.neighbours(forest, 80).collect()}
    assert got >= {(i, i + w) for i in range(n) for w in range(1, neardup.REACH + 1) if i + w < n}


def test_the_filter_lets_all_wanted_texts_through(spark, frame):
    docs = frame([(i, f"text {i}") for i in range(3000)])
    slim = neardup._slim(docs)
    wanted = slim.filter("doc_id % 10 = 3").select("doc_id", "text_hash")
    through = {r[0] for r in neardup._perhaps(slim, wanted).select("doc_id").collect()}
    assert set(range(3, 3000, 10)) <= through and len(through) < 400


def test_near_copies_in_a_crowd_of_variants(frame):
    # 2,500 texts with a fifth of their words in common, and 300 near copies of some of them.
    r = random.Random(11)
    vocabulary = [f"w{i}" for i in range(5000)]
    shared = [r.choice(vocabulary) for _ in range(40)]
    texts = [shared + [r.choice(vocabulary) for _ in range(60)] for _ in range(2500)]
    copies = [list(texts[k]) for k in range(300)]
    for w in copies:
        w[r.randrange(5, 95)] = "changed"
    docs = [(i, " ".join(w)) for i, w in enumerate(texts + copies)]
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(frame(docs), 2).collect()}
    sets = {i: shingles(t, 2) for i, t in docs}
    near = {k: 2500 + k for k in range(300) if 100 * len(sets[k] & sets[2500 + k]) >= 80 * len(sets[k] | sets[2500 + k])}
    assert len(near) > 250
    assert all(got[b] == a for a, b in near.items())
