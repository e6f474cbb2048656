"""Decontamination against loops over windows."""

import hashlib
import re

from paceline.llm import decontaminate as d

WORDS = re.compile(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORDS.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=10):
    wins = set()
    for item, text in items:
        w = words(text)
        if w and item is not None:
            k = min(window, len(w))
            wins |= {(str(item), tuple(w[i : i + k])) for i in range(len(w) - k + 1)}
    out = []
    for doc, text in docs:
        w, hit, names = words(text), set(), set()
        for item, win in wins:
            k = len(win)
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) == win:
                    hit |= set(range(i, i + k))
                    names.add(item)
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(names), digest, bool(hit)))
    return sorted(out, key=str)


PASSAGE = "one two three four five six seven eight nine ten eleven twelve"
ITEMS = [(1, PASSAGE), (2, "Short ITEM"), (3, None), (4, ""), (10, PASSAGE + " x"), (None, "rest"), (5, "!!! ---"), (2, "other part of two")]
DOCS = [
    (1, None),
    (2, ""),
    (3, PASSAGE.upper().replace(" ", " -- ")),
    (4, "one two three four five six seven eight nine"),
    (5, "x " + PASSAGE + " " + PASSAGE),
    (6, "a short item, short item short"),
    (7, "other part of two rest"),
    (8, "filler " * 30_000 + PASSAGE),
    (9, "naïve short item"),
    (5, "short item"),
    (None, "short item"),
]


def items_of(spark, rows):
    return spark.createDataFrame(rows, "item_id bigint, text string")


def rows_of(df):
    return sorted(map(tuple, df.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()), key=str)


def test_report(spark, frame):
    df = frame(DOCS).selectExpr("*", "1 as n_words", "2 as row_key")
    assert rows_of(d.report(df, items_of(spark, ITEMS))) == brute(DOCS, ITEMS)
    assert rows_of(d.report(frame([]), items_of(spark, ITEMS))) == []
    assert rows_of(d.report(frame(DOCS), items_of(spark, []))) == brute(DOCS, [])


def test_several_blocks_give_the_same(spark, frame, monkeypatch):
    blocks = d.query_blocks
    monkeypatch.setattr(d, "query_blocks", lambda items: blocks(items, 100))
    assert len(list(d.query_blocks(items_of(spark, ITEMS)))) > 3
    assert rows_of(d.report(frame(DOCS), items_of(spark, ITEMS))) == brute(DOCS, ITEMS)


def test_proximity(spark, frame):
    near = [(1, "one two x three four five six seven eight nine y ten"), (2, "nothing here"), (3, "ten nine eight seven")]
    index = d.build_index(frame(near))
    item = items_of(spark, [(1, "one two three four five six seven eight nine ten")])
    assert d.matches(index, item).count() == 0
    assert d.proximity_matches(index, item, slop=2).count() == 1


def test_dropping(spark, frame):
    kept = d.drop_contaminated(frame(DOCS), items_of(spark, ITEMS))
    assert kept.columns == frame([]).columns
    assert sorted((r[0] for r in kept.collect()), key=str) == sorted([1, 2, 4, 8, None], key=str)[:0] + sorted(
        [x for x in [i for i, *_ , c in brute(DOCS, ITEMS) if not c] if x != 5] + [None], key=str
    )
