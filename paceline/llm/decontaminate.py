"""Benchmark decontamination by a distributed positional inverted index.

The index is cut by document into segments: each holds, for every term of its
documents, the sorted positions at which it stands.  Segments are written once
to shared storage.  A window of test words is looked up in every segment by
intersecting position lists shifted by the words' offsets, from the rarest word
of the window up, so common words are only ever probed, never walked.

A segment's documents are laid end to end with a gap, so no match can run from
one into the next, and each document lies in one segment whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.llm.common import ALNUM, hash_words, text_blocks, widened
from paceline.session import materialize

#: Consecutive words of an item that make a window.
WINDOW = 10

#: Bytes of text in a segment, about; a longer document is a segment of its own.
SEGMENT_BYTES = 4_000_000

#: Bytes of test text looked up in one pass over the index.
QUERY_BYTES = 16_000_000

_SEGMENT = (
    "row_keys binary, doc_ids binary, has_id binary, starts binary, lengths binary, "
    "terms binary, list_starts binary, positions binary"
)
_MATCH = "row_key bigint, item_id string, first int, last int"


@dataclass
class Segment:
    """Documents ``row_keys`` begin at ``starts`` and have ``lengths`` words;
    the k-th of the sorted ``terms`` stands at
    ``positions[list_starts[k]:list_starts[k + 1]]``."""

    row_keys: np.ndarray
    doc_ids: np.ndarray
    has_id: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    terms: np.ndarray
    list_starts: np.ndarray
    positions: np.ndarray

    TYPES = (np.int64, np.int64, np.uint8, np.int32, np.int32, np.uint64, np.int32, np.int32)

    @classmethod
    def build(cls, row_keys, doc_ids, has_id, hashes, rows, gap: int) -> Segment:
        lengths = np.diff(rows).astype(np.int32)
        starts = (rows[:-1] + gap * np.arange(len(lengths))).astype(np.int32)
        places = np.arange(len(hashes), dtype=np.int32) + np.repeat(starts - rows[:-1].astype(np.int32), lengths)
        order = np.argsort(hashes, kind="stable")
        sorted_ = hashes[order]
        new = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(sorted_) else np.zeros(0, int)
        return cls(
            row_keys, doc_ids, has_id, starts, lengths, sorted_[new], np.append(new, len(sorted_)), places[order]
        )

    def columns(self) -> list[bytes]:
        values = (getattr(self, f) for f in self.__dataclass_fields__)
        return [np.asarray(v, t).tobytes() for v, t in zip(values, self.TYPES, strict=True)]

    @classmethod
    def load(cls, columns: list[bytes]) -> Segment:
        return cls(*(np.frombuffer(c, t) for c, t in zip(columns, cls.TYPES, strict=True)))

    def lists(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and length of each term's list; length 0 for terms not here."""
        k = np.searchsorted(self.terms, terms)
        k[k == len(self.terms)] = 0
        here = self.terms[k] == terms if len(self.terms) else np.zeros(len(terms), bool)
        begin = self.list_starts[k]
        return begin, np.where(here, self.list_starts[np.minimum(k + 1, len(self.list_starts) - 1)] - begin, 0)


def build_index(docs: DataFrame, window: int = WINDOW, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """The index of ``docs`` (doc_id, text), one row per segment, written to shared storage.

    Words are A-Z lower-cased runs of digits, letters and non-ASCII.  Null and
    empty texts have no postings but keep their row.
    """

    def rows(batches):
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = batch.column("doc_id")
            known = np.asarray(ids.is_valid())
            numbers = np.asarray(ids.fill_null(0))
            begin, held, size = 0, [], 0
            for first, end, data, offsets in text_blocks(batch.column("text")):
                held.append(hash_words(data, offsets, ALNUM))
                size += len(data)
                if size < segment_bytes and end < batch.num_rows:
                    continue
                hashes = np.concatenate([h for h, _ in held])
                before = np.cumsum([0, *(len(h) for h, _ in held)])
                words = np.concatenate([[0], *(w[1:] + at for (_, w), at in zip(held, before, strict=False))])
                keys = (part << 40) + n + np.arange(begin, end)
                seg = Segment.build(keys, numbers[begin:end], known[begin:end], hashes, words, window)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([c], pa.binary()) for c in seg.columns()], list(Segment.__dataclass_fields__)
                )
                begin, held, size = end, [], 0
            n += batch.num_rows

    slim = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return materialize(widened(docs.sparkSession, slim).mapInArrow(rows, _SEGMENT), "postings")


@dataclass
class Queries:
    """Windows of items: the hashes of their words laid end to end."""

    item: list[str]  # of each window
    terms: np.ndarray  # of all windows
    begin: np.ndarray  # of each window in terms, and the end

    @classmethod
    def of(cls, items: list[tuple[str, str]], window: int) -> Queries:
        owners: list[str] = []
        parts: list[np.ndarray] = []
        seen: set[tuple[str, bytes]] = set()
        for item_id, text in items:
            raw = np.frombuffer(text.encode(), np.uint8)
            words, _ = hash_words(raw, np.array([0, len(raw)]), ALNUM)
            for at in range(max(1, len(words) - window + 1) if len(words) else 0):
                part = words[at : at + window]
                if (key := (item_id, part.tobytes())) not in seen:
                    seen.add(key)
                    owners.append(item_id)
                    parts.append(part)
        begin = np.cumsum([0, *map(len, parts)])
        return cls(owners, np.concatenate(parts) if parts else np.zeros(0, np.uint64), begin)


def query_blocks(items: DataFrame, block_bytes: int = QUERY_BYTES) -> Iterator[list[tuple[str, str]]]:
    """(item_id, text) of the test items, in blocks of bounded size.

    The test set is the stated query set.  Its size is measured first; items are
    dealt into as many blocks as that takes, and one block at a time is fetched.
    """
    rows = items.select(F.col("item_id").cast("string"), F.coalesce("text", F.lit("")).alias("text")).filter(
        F.col("item_id").isNotNull()
    )
    total = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    for k in range(blocks):
        part = rows.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k) if blocks > 1 else rows
        yield [(r[0], r[1]) for r in part.collect()]


def phrase_places(seg: Segment, q: Queries, slop: int = 0) -> Iterator[tuple[int, np.ndarray]]:
    """(window, positions where it starts) for every window found in a segment.

    With ``slop``, a word may stand up to so many places from where it should.
    """
    if not len(q.terms):
        return
    distinct, back = np.unique(q.terms, return_inverse=True)
    begin, size = seg.lists(distinct)
    sizes = size[back]
    least = np.minimum.reduceat(sizes, q.begin[:-1])
    for w in np.flatnonzero(least > 0):
        a, b = q.begin[w], q.begin[w + 1]
        rarest = np.argsort(sizes[a:b], kind="stable")
        found = None
        for offset in rarest:
            k = back[a + offset]
            shifted = seg.positions[begin[k] : begin[k] + size[k]] - offset
            if found is None:
                found = shifted
                continue
            at = np.searchsorted(shifted, found - slop)
            inside = at < len(shifted)
            at[~inside] = 0
            found = found[inside & (shifted[at] <= found + slop)]
            if not len(found):
                break
        if len(found):
            yield int(w), found


def _covered(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges [first, last) joined where they touch."""
    order = np.argsort(first, kind="stable")
    first, last = first[order], np.maximum.accumulate(last[order])
    new = np.concatenate([[True], first[1:] > last[:-1]])
    return first[new], last[np.append(np.flatnonzero(new)[1:] - 1, len(last) - 1)]


def matches(index: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = 0) -> DataFrame:
    """Where items stand: row_key, item_id, first, last (word range in the document, end excluded).

    Exact phrases for ``slop`` 0, else proximity matches.  Ranges of one item
    that touch are joined, so an item gives a document few rows however often
    its windows overlap.
    """
    spark: SparkSession = index.sparkSession
    out: DataFrame | None = None
    for block in query_blocks(items):
        # A block's size is bounded by query_blocks.
        shared = spark.sparkContext.broadcast(Queries.of(block, window))

        def rows(batches, shared=shared):
            q = shared.value
            names = sorted(set(q.item))
            number = {name: i for i, name in enumerate(names)}
            owner = np.array([number[i] for i in q.item], np.int64)
            for batch in batches:
                for k in range(batch.num_rows):
                    seg = Segment.load([batch.column(c)[k].as_py() for c in Segment.__dataclass_fields__])
                    found = list(phrase_places(seg, q, slop))
                    if not found:
                        continue
                    windows = np.repeat([w for w, _ in found], [len(p) for _, p in found])
                    start = np.concatenate([p for _, p in found]).astype(np.int64)
                    doc = np.searchsorted(seg.starts, start + slop, side="right") - 1
                    doc = np.maximum(doc, 0)
                    stop = start + (q.begin[windows + 1] - q.begin[windows]) + slop
                    start = np.maximum(start - slop, seg.starts[doc])
                    stop = np.minimum(stop, seg.starts[doc].astype(np.int64) + seg.lengths[doc])
                    pair = doc * len(names) + owner[windows]
                    width = int(stop.max()) + 2  # keeps ranges of different pairs apart
                    ranks, group = np.unique(pair, return_inverse=True)
                    a, b = _covered(start + group * width, stop + group * width)
                    group = a // width
                    doc = ranks[group] // len(names)
                    a, b = a - group * width - seg.starts[doc], b - group * width - seg.starts[doc]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(seg.row_keys[doc], pa.int64()),
                            pa.array([names[i] for i in ranks[group] % len(names)], pa.string()),
                            pa.array(a.astype(np.int32)),
                            pa.array(b.astype(np.int32)),
                        ],
                        ["row_key", "item_id", "first", "last"],
                    )

        part = index.mapInArrow(rows, _MATCH)
        out = part if out is None else out.unionByName(part)
    return out


def proximity_matches(index: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = 2) -> DataFrame:
    """As ``matches``, each word up to ``slop`` places off."""
    return matches(index, items, window, slop)


def _documents(index: DataFrame) -> DataFrame:
    """row_key, doc_id, n_words of every indexed row."""

    def rows(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                keys, ids, known, lengths = (
                    np.frombuffer(batch.column(c)[k].as_py(), t)
                    for c, t in (("row_keys", np.int64), ("doc_ids", np.int64), ("has_id", np.uint8), ("lengths", np.int32))
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys),
                        pa.array(ids, mask=known == 0),
                        pa.array(lengths.astype(np.int64)),
                    ],
                    ["row_key", "doc_id", "n_words"],
                )

    slim = index.select("row_keys", "doc_ids", "has_id", "lengths")
    return slim.mapInArrow(rows, "row_key bigint, doc_id bigint, n_words bigint")


def report(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null text has no words.  Items without words, or without an id, match
    nothing.  Rows that repeat a doc_id are judged each for itself.
    """
    index = build_index(docs, window)
    found = matches(index, items, window)
    per_row = found.groupBy("row_key").agg(
        F.sort_array(F.collect_set("item_id")).alias("items"),
        F.sort_array(F.collect_list(F.struct("first", "last"))).alias("ranges"),
    )
    n_hit = F.aggregate(
        "ranges",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, r: F.struct(
            (a["n"] + F.greatest(F.lit(0), r["last"] - F.greatest(a["end"], r["first"]))).alias("n"),
            F.greatest(a["end"], r["last"]).alias("end"),
        ),
        lambda a: a["n"],
    )
    digests = per_row.select(
        "row_key",
        n_hit.cast("bigint").alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
    )
    zero = F.lit(0).cast("bigint")
    return (
        _documents(index)
        .join(digests, "row_key", "left")
        .select(
            "doc_id",
            "n_words",
            F.coalesce("n_hit", zero).alias("n_hit"),
            F.coalesce("n_items", zero).alias("n_items"),
            F.coalesce("items_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("items_sha256"),
            (F.coalesce("n_hit", zero) > 0).alias("contaminated"),
        )
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the documents in which a window of an item occurs.

    Rows that share a doc_id go together; rows without one stay.
    """
    bad = report(docs, items, window).filter("contaminated and doc_id is not null").select(F.col("doc_id").alias("__bad"))
    return docs.join(bad.distinct(), docs["doc_id"].cast("bigint") == F.col("__bad"), "left_anti")
