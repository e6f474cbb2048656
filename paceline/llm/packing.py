"""Packing documents into token sequences: first-fit decreasing over a
tournament tree of bin capacities, in randomised groups of documents.

Texts are tokenised once, in the tasks that read them; from there on only
(document, start, length) rows travel.  Groups are drawn from what a document is,
not from where it lies, so a task run again gives the same rows and another layout
of the files the same packing.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.llm.common import byte_signs, widened

#: Tokens in a sequence.
SEQUENCE = 2048

#: Appended to every document.
END_ID = 1

#: Documents a group holds on average.  Groups are drawn by hash, so a group
#: follows the length distribution of the whole whatever source is hot.
GROUP_DOCS = 4096

_PIECES = "doc_key bigint, doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


#: Up to here all signs have been letters, numbers or neither for so long that
#: both libraries agree on how to split them.
_COMMON = re.compile("[^\0-\u058f]")


class TextTokens:
    """Token ids of whole texts, those the tokenizers library gives.

    Texts of common signs go through tiktoken, which merges by the same ranks and
    is several times as fast; the vocabulary is read from the one file and its
    order checked.  All other texts go through the library itself.
    """

    def __init__(self, path: str):
        # Tasks share a machine's cores already.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        vocabulary, model = parts["model"]["vocab"], parts["model"]
        made = [vocabulary["".join(m) if isinstance(m, list) else m.replace(" ", "", 1)] for m in model["merges"]]
        self.fast = None
        if parts["pre_tokenizer"]["type"] == "ByteLevel" and made == sorted(made):
            import tiktoken
            from public_tokenizers import PATTERN

            byte_of = {sign: b for b, sign in enumerate(byte_signs())}
            special = {t["content"]: t["id"] for t in parts["added_tokens"]}
            ranks = {bytes(byte_of[c] for c in t): i for t, i in vocabulary.items() if t not in special}
            self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def __call__(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if self.fast is None or _COMMON.search(text):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode(text, allowed_special="all")
        return np.asarray(ids, "<u4").tobytes()


@lru_cache(maxsize=2)
def tokens_of(path: str) -> TextTokens:
    """A worker's tokenizer, kept from task to task."""
    return TextTokens(path)


def pieces_of(n: int, sequence: int) -> Iterator[tuple[int, int]]:
    """Full sequences from the front, then what is left."""
    for start in range(0, n, sequence):
        yield start, min(sequence, n - start)


def cut(docs: DataFrame, tokenizer_path: str, sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_key, doc_id, start, length, ids_crc32, doc_tokens.

    ``doc_key`` is a hash of doc_id and text; rows alike in both have the same pieces.
    """
    end = np.array([end_id], "<u4").tobytes()

    def rows(batches):
        tokens = tokens_of(tokenizer_path)
        for batch in batches:
            keys, ids = batch.column("doc_key").to_pylist(), batch.column("doc_id").to_pylist()
            texts = batch.column("text")
            at = 0
            while at < len(ids):  # bounded runs of texts
                stop, size = at, 0
                while stop < len(ids) and size < 1_000_000:
                    size += len(texts[stop].as_py() or "") + 1
                    stop += 1
                out: list[tuple] = []
                run = slice(at, stop)
                for key, doc_id, text in zip(keys[run], ids[run], texts.slice(at, stop - at).to_pylist(), strict=True):
                    raw = tokens(text or "") + end
                    total = len(raw) // 4
                    out += [
                        (key, doc_id, s, k, zlib.crc32(raw[4 * s : 4 * (s + k)]), total)
                        for s, k in pieces_of(total, sequence)
                    ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in zip(*out, strict=True)],
                    ["doc_key", "doc_id", "start", "length", "ids_crc32", "doc_tokens"],
                )
                at = stop

    slim = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    slim = slim.select(F.xxhash64("doc_id", "text").alias("doc_key"), "doc_id", "text")
    return widened(docs.sparkSession, slim).mapInArrow(rows, _PIECES)


class Bins:
    """Bins of one capacity under a tournament tree of what is left in them.

    A node holds the larger capacity below it, so the first bin with room is
    found, and filled, in as many steps as the tree is high.
    """

    def __init__(self, capacity: int, most: int):
        self.capacity, self.leaves, self.used = capacity, 1, 0
        while self.leaves < max(1, most):
            self.leaves *= 2
        self.tree = [capacity] * (2 * self.leaves)

    def put(self, length: int) -> tuple[int, int]:
        """(bin, offset in it) of a piece, put into the first bin with room."""
        tree, node = self.tree, 1
        while node < self.leaves:
            node *= 2
            if tree[node] < length:
                node += 1
        offset = self.capacity - tree[node]
        tree[node] -= length
        bin_ = node - self.leaves
        self.used = max(self.used, bin_ + 1)
        node //= 2
        while node:
            tree[node] = max(tree[2 * node], tree[2 * node + 1])
            node //= 2
        return bin_, offset


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece, longest first, ties in the given order."""
    bins, place = Bins(capacity, len(lengths)), np.zeros((2, len(lengths)), np.int64)
    for i in np.argsort(-lengths, kind="stable"):
        place[:, i] = bins.put(int(lengths[i]))
    return place[0], place[1]


def pack(pieces: DataFrame, n_docs: int, sequence: int = SEQUENCE, group_docs: int = GROUP_DOCS) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``.

    Documents are dealt into about n_docs / group_docs groups by their key; each
    group is packed by itself.  A group's sequence ids start at group * 2^32.
    Rows alike in all columns are counted, then numbered, and each number is dealt
    by itself: they spread over the groups however many they are.  The result
    depends on the rows alone, not on their order or files.
    """
    groups = max(1, -(-n_docs // group_docs))

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_key", "ascending"), ("__copy", "ascending"), ("start", "ascending")])
        bins, offsets = first_fit_decreasing(table["length"].to_numpy(), sequence)
        group = table["__group"][0].as_py()
        return (
            table.drop_columns(["__group", "doc_key", "__copy"])
            .append_column("sequence_id", pa.array(bins + (group << 32), pa.int64()))
            .append_column("offset", pa.array(offsets, pa.int64()))
        )

    schema = (
        "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
        "sequence_id bigint, offset bigint"
    )
    alike = pieces.groupBy(*pieces.columns).agg(F.count(F.lit(1)).alias("__copies"))
    copies = alike.withColumn("__copy", F.explode(F.expr("sequence(1L, __copies)"))).drop("__copies")
    dealt = copies.withColumn("__group", F.pmod(F.xxhash64("doc_key", "__copy"), F.lit(groups)))
    return dealt.groupBy("__group").applyInArrow(one, schema)


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    sequence: int = SEQUENCE,
    group_docs: int = GROUP_DOCS,
    end_id: int = END_ID,
) -> DataFrame:
    """Every document's tokens, ended by ``end_id``, in sequences of ``sequence``.

    One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset.  Null and empty texts are the end id alone; rows that repeat a doc_id
    (or lack one) are packed each for itself; an empty table gives no rows; other
    columns of ``docs`` are not read.
    """
    n_docs = docs.count()
    return pack(cut(docs, tokenizer_path, sequence, end_id), n_docs, sequence, group_docs)
