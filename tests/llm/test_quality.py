"""Quality rules against loops over words and lines."""

import re
from collections import Counter

from paceline.llm import quality


def brute(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0d]+", t)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    marked = {p for i, w in enumerate(windows) if often[w] > 1 for p in range(i, i + 5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", t)),
        "n_lines": len(lines),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(marked),
    }


CASES = [
    (1, None),
    (2, ""),
    (3, " \t\n\r\x0b\x0c "),
    (4, "a b c d e"),
    (5, "a b c d e a b c d e"),
    (6, "a a a a a a"),
    (7, "x\n\nx\n x\nx"),
    (8, "é ü 漢字 #*$%&|<>     y"),
    (9, "long " * 30_000),
    (10, "w" * 200_000),
    (11, " " * 100_000 + "end"),
    (12, "".join(f"w{i} " for i in range(20_000))),
    (5, "a b c d e a b c d e"),
    (None, "no id here"),
]


def test_measurements(frame):
    got = quality.measure(frame(CASES)).collect()
    assert len(got) == len(CASES)
    for row in got:
        assert {k: row[k] for k in brute("")} == brute(row["text"]), row["doc_id"]


def test_given_documents(frame, texts):
    for row in quality.measure(frame(texts)).collect():
        assert {k: row[k] for k in brute("")} == brute(row["text"]), row["doc_id"]


def test_clashing_columns_and_empty_tables(frame):
    df = frame([(1, "a b")]).selectExpr("*", "'x' as n_words", "'y' as failed", "1 as kept")
    row = quality.apply_policy(quality.ledger(df), 2).collect()[0]
    assert (row["n_words"], row["kept"]) == (2, False)
    assert quality.ledger(frame([])).collect() == []


def test_policies_and_ablation(frame, texts):
    rows = quality.ledger(frame(texts)).cache()
    masks = [r["failed"] for r in rows.collect()]
    bits = {r.name: 1 << r.bit for r in quality.RULES}
    for version, names in quality.POLICIES.items():
        policy = sum(bits[n] for n in names)
        kept = quality.apply_policy(rows, version).filter("kept").count()
        assert kept == sum(not m & policy for m in masks)
        table = {r["rule"]: r for r in quality.ablation(rows, version).collect()}
        assert set(table) == set(names)
        for n in names:
            assert table[n]["n_failed"] == sum(bool(m & bits[n]) for m in masks)
            assert table[n]["n_only_this"] == sum(m & policy == bits[n] for m in masks)
            assert table[n]["n_kept_without"] == sum(not m & (policy & ~bits[n]) for m in masks)
    empty = quality.ablation(quality.ledger(frame([])), 1).collect()
    assert [(r["n_failed"], r["n_kept_without"]) for r in empty] == [(0, 0)] * 2
