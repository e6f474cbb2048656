"""Packing: pieces are checked against the library's ids, bins against a plain first fit."""

import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from paceline.llm import packing
from paceline.llm.queries import tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")

CASES = [
    (1, None),
    (2, ""),
    (3, "  a  b \n c\n\n d\t e "),
    (4, "Hello <|endoftext|> there<|endoftext|>"),
    (5, "漢字   x   y 😀"),
    (6, "word " * 30_000),
    (7, "z" * 50_000),
    (1, "repeated id"),
    (None, "no id"),
    (8, " leading and trailing "),
]


def test_pieces_and_sequences(frame, texts):
    library = Tokenizer.from_file(PATH)
    cases = CASES + texts
    ids = defaultdict(list)
    for i, t in cases:
        ids[i].append(library.encode(t or "", add_special_tokens=False).ids + [1])
    rows = packing.pack_documents(frame(cases).selectExpr("*", "1 as offset", "2 as __group"), PATH, group_docs=64).collect()
    found = defaultdict(list)
    fill = defaultdict(list)
    for r in rows:
        found[r["doc_id"]].append(r)
        fill[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(found) == set(ids)
    for i, own in ids.items():
        pieces = sorted((p["doc_tokens"], p["start"], p["length"], p["ids_crc32"]) for p in found[i])
        want = sorted(
            (len(x), s, len(x[s : s + 2048]), zlib.crc32(np.asarray(x[s : s + 2048], "<u4").tobytes()))
            for x in own
            for s in range(0, len(x), 2048)
        )
        assert pieces == want, i
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r["length"] for r in rows)
    assert len(fill) <= total / 2048 + len(texts) / 64 + 2
    assert packing.pack_documents(frame([]), PATH).collect() == []


def test_the_same_packing_from_other_files(frame, texts):
    """Order and partitions do not matter, whole repeated rows spread over the groups."""
    cases = CASES + texts + [(99_999, "copied " * 300)] * 500
    docs = frame(cases)
    rows = [sorted(map(tuple, packing.pack_documents(d, PATH, group_docs=64).collect()), key=str) for d in (docs.coalesce(1), docs.orderBy("n_chars").repartition(7))]
    assert rows[0] == rows[1]
    groups = [r[5] >> 32 for r in rows[0] if r[0] == 99_999]
    assert len(groups) == 500 and max(map(groups.count, set(groups))) < 125


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_first_fit_decreasing(lengths):
    bins, offsets = packing.first_fit_decreasing(np.array(lengths, np.int64), 64)
    left = []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        k = next((k for k, c in enumerate(left) if c >= lengths[i]), None)
        if k is None:
            left.append(64)
            k = len(left) - 1
        assert (bins[i], offsets[i]) == (k, 64 - left[k])
        left[k] -= lengths[i]
