"""Token counts against the library itself, at every prefix."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from paceline.llm import tokens
from paceline.llm.queries import tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def prefixes():
    return tokens.TextPrefixes(PATH)


CASES = [
    (1, None),
    (2, ""),
    (3, "  \n\t "),
    (4, "Hello, WORLD's don't 12345 !!??"),
    (5, "<|endoftext|>a<|startoftext|>  <|endoftext|"),
    (6, "é É ſ İ Σ ς ΣΑΣ  x y\x85z \x1c\x1d"),
    (7, "漢字かな 한글 \U0001f600\U0001f468‍\U0001f469 ñandú"),
    (8, "ab" * 3000),
    (9, "the quick brown fox " * 3000),
    (4, "Hello, WORLD's don't 12345 !!??"),
    (None, "no id"),
]


def test_counts(frame, library, texts):
    cases = CASES + texts
    got = tokens.count_tokens(frame(cases), PATH).collect()
    assert len(got) == len(cases)
    for r in got:
        t = r["text"] or ""
        n = len(library.encode(t, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), n, n > 2048), r["doc_id"]


def check_prefixes(prefixes, library, text):
    form, counts = prefixes.form(text), prefixes(text)
    assert len(counts) == len(form) + 1
    for p in range(len(form) + 1):
        assert counts[p] == len(library.encode(form[:p], add_special_tokens=False).ids), (text, p)


def test_every_prefix(prefixes, library, texts):
    for _, text in [c for c in CASES if len(c[1] or "") < 200] + [(i, t[:300]) for i, t in texts[:40] if t]:
        check_prefixes(prefixes, library, text or "")


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("abcdehilnorstu ABÉé'<|>endoftx1!\n漢ñ"), max_size=40))
def test_any_prefix(text):
    check_prefixes(tokens.TextPrefixes(PATH) if not hasattr(test_any_prefix, "p") else test_any_prefix.p, test_any_prefix.lib, text)


test_any_prefix.p = tokens.TextPrefixes(PATH)
test_any_prefix.lib = Tokenizer.from_file(PATH)


def test_a_word_of_a_million_letters(library):
    import random
    import resource

    r = random.Random(3)
    word = "".join(r.choice("abcdefghijklmnopqrstuvwxyzéñ") for _ in range(1_000_000))
    own = tokens.TextPrefixes(PATH)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert own.total(word + " and the rest") == len(library.encode(word + " and the rest", add_special_tokens=False).ids)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1_000_000  # KB, the library's share included
    short = word[:3000]
    check = own(short)
    for p in (1, 63, 64, 65, 66, 200, 255, 256, 257, 1000, 2999, 3000):
        assert check[p] == len(library.encode(short[:p], add_special_tokens=False).ids)


def test_truncation_and_budgets(frame, library):
    df = tokens.truncate(frame(CASES[:7]), PATH, budget=5)
    for r in df.collect():
        n = len(library.encode(r["kept_text"], add_special_tokens=False).ids)
        assert n == r["kept_tokens"] <= 5
    table = tokens.prefix_counts(frame([(1, "one two three"), (2, None)]), PATH)
    got = table.select("doc_id", tokens.tokens_of_prefix(7).alias("n"), "normal_text").orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(1, 2, "one two three"), (2, 0, "")]


def test_clashing_columns_and_empty_tables(frame):
    df = frame([(1, "a b")]).selectExpr("*", "'x' as n_tokens", "1 as over_limit")
    assert tokens.count_tokens(df, PATH).collect()[0]["n_tokens"] == 2
    assert tokens.count_tokens(frame([]), PATH).collect() == []
