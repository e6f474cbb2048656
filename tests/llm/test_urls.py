"""The URL filter against plain string searches."""

import random

import pytest

from paceline.llm import urls

VOCABULARY = (("spam", "xx x", "bad-word"), {"free": 1.0, "bet": 1.5, "win": 1.0, "in": 0.5})


def stands(low, term):
    inner = "abcdefghijklmnopqrstuvwxyz0123456789"
    at = low.find(term)
    while at >= 0:
        before, after = low[at - 1 : at] if at else "", low[at + len(term) : at + len(term) + 1]
        if not (before and before in inner) and not (after and after in inner):
            return True
        at = low.find(term, at + 1)
    return False


def brute(url, strict, soft):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in url or "")
    s = sorted(t for t in strict if stands(low, t))
    w = sorted(t for t in soft if stands(low, t))
    return s, w, sum(soft[t] for t in w)


def test_terms(spark):
    r = random.Random(3)
    parts = ["spam", "free", "bet", "win", "in", "bad-word", "a", "1", "-", "/", ".", "é", "FREE", "xx x"]
    rows = [(i, "".join(r.choice(parts) for _ in range(r.randrange(9)))) for i in range(300)] + [(None, None), (7, "x" * 100_000 + "-spam")]
    df = spark.createDataFrame(rows, "page_id bigint, url string").selectExpr("*", "1 as soft_weight")
    got = urls.term_hits(df, *VOCABULARY).collect()
    assert len(got) == len(rows)
    for row in got:
        assert (row["strict_terms"], row["soft_terms"], row["soft_weight"]) == brute(row["url"], *VOCABULARY)
    assert urls.term_hits(df, (), {}).filter("soft_weight > 0").isEmpty()


def test_rules_and_verdicts(spark):
    cases = {
        None: ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        "no scheme.net/": ("", "", None, "allow"),
        "http://A.NET/x": ("a.net", "/x", "net/", "block"),
        "http://net/": ("net", "/", "net/", "block"),
        "http://net": ("net", "", None, "allow"),
        "http://Www.Example.net/en/1?x#y": ("www.example.net", "/en/1", "example.net/en/", "allow"),
        "http://example.net/EN/1": ("example.net", "/EN/1", "net/", "block"),
        "http://notexample.com/de/": ("notexample.com", "/de/", None, "allow"),
        "http://example.com/de/spam": ("example.com", "/de/spam", "example.com/de/", "block"),
        "http://x.org/fr/spam": ("x.org", "/fr/spam", "org/fr/", "allow"),
        "http://y.org/spam": ("y.org", "/spam", None, "block"),
        "http://y.org/free": ("y.org", "/free", None, "allow"),
        "http://y.org/free-free": ("y.org", "/free-free", None, "allow"),
        "http://y.org/free-win": ("y.org", "/free-win", None, "block"),
        "http://x.org?a=/b://c": ("x.org", "", None, "allow"),
    }
    rows = [(i, u) for i, u in enumerate(cases)]
    df = spark.createDataFrame(rows, "page_id bigint, url string").selectExpr("*", "'?' as host", "'?' as verdict", "1 as rule")
    got = {r["url"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(df).collect()}
    assert got == cases
    assert urls.judge(df.limit(0)).collect() == []


def test_one_soft_term_is_not_several(spark):
    df = spark.createDataFrame([(1, "http://y.org/heavy"), (2, "http://y.org/heavy-heavy"), (3, "http://y.org/heavy/light"), (4, "http://y.org/light/faint")], "page_id bigint, url string")
    soft = {"heavy": 5.0, "light": 0.5, "faint": 0.5}
    got = {r["page_id"]: r["verdict"] for r in urls.judge(df, (), (), soft).collect()}
    assert got == {1: "allow", 2: "allow", 3: "block", 4: "allow"}


def test_encoded_terms(spark):
    cases = [(1, "http://y.org/%73pam"), (2, "http://y.org/a%20spam%2fx"), (3, "http://y.org/%FFfree+%62et"), (4, "http://y.org/100%"), (5, None)]
    df = spark.createDataFrame(cases, "page_id bigint, url string")
    plain = {r["page_id"]: r["verdict"] for r in urls.judge(df, (), *VOCABULARY).collect()}
    read = {r["page_id"]: (r["strict_terms"], r["soft_terms"], r["soft_weight"], r["verdict"]) for r in urls.judge(df, (), *VOCABULARY, decode=True).collect()}
    assert plain == {1: "allow", 2: "allow", 3: "allow", 4: "allow", 5: "allow"}
    assert read == {
        1: (["spam"], [], 0.0, "block"),
        2: (["spam"], [], 0.0, "block"),
        3: ([], ["bet", "free"], 2.5, "block"),
        4: ([], [], 0.0, "allow"),
        5: ([], [], 0.0, "allow"),
    }


def test_vocabulary_of_a_table(spark):
    rows = [("Spam", None), ("spam", 3.0), ("free", 1.0), ("FREE", 2.0), ("", 1.0), (None, None)]
    table = spark.createDataFrame(rows, "term string, weight double")
    assert urls.read_vocabulary(table) == (("spam",), {"free": 2.0})
    assert urls.read_vocabulary(table.limit(0)) == ((), {})
    with pytest.raises(ValueError, match="more than 1 terms"):
        urls.read_vocabulary(table, most=1)
    with pytest.raises(ValueError, match="negative"):
        urls.read_vocabulary(spark.createDataFrame([("a", -1.0)], "term string, weight double"))
