"""Helpers the operators share: Arrow text batches and vectorised word hashes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text worked on at a time inside a task; temporary arrays take some 60 times as much.
BLOCK_BYTES = 500_000

#: Words of more bytes than this are hashed as streams.
LONG_WORD = 65_536

#: Words end at these bytes in most contracts: space and U+0009 to U+000D.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[list(SPACES)] = False

#: Digits, a-z and everything beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def widened(spark: SparkSession, df: DataFrame) -> DataFrame:
    """``df`` with no fewer partitions than cores, for work that is all in the tasks.

    A small file is one partition; without this one core would do everything.
    """
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the public splitmix64 constants); one to one."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_multipliers = mix(np.arange(1, 4097, dtype=np.uint64))


def _factors(n: int) -> np.ndarray:
    """Random 64-bit factors per position in a word, as many as the longest word has."""
    global _multipliers
    if len(_multipliers) < n:
        _multipliers = mix(np.arange(1, 2 * n + 1, dtype=np.uint64))
    return _multipliers


def text_blocks(texts: pa.Array, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets) of runs of rows; null is empty.

    A run ends before it exceeds ``block_bytes``; a longer row is a run of its own.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + block_bytes, side="right")) - 1
        end = min(n, max(end, first + 1))
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def byte_signs() -> list[str]:
    """The sign that stands for each byte: itself if it prints, else the next free one from U+0100."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in prints]
    return [chr(b) if b in prints else chr(0x100 + others.index(b)) for b in range(256)]


def _run_parts(
    data: np.ndarray, inner: np.ndarray, keep: np.ndarray, beginnings: tuple[int, ...]
) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Word hashes, hashes of beginnings with their words' places, and word starts; words also end at ``inner``."""
    n = len(data)
    nothing = np.zeros(0, np.uint64)
    none = nothing, [(nothing, np.zeros(0, int))] * len(beginnings), np.zeros(0, np.int64)
    if not n:
        return none
    folded = LOWER[data]
    inside = keep[folded]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[inner[inner < n]] = False
    starts = np.flatnonzero(inside & ~before)
    if not len(starts):
        return none
    at = np.cumsum(inside) - 1  # place of each byte among the kept ones
    first = at[starts]
    lengths = np.diff(np.append(first, at[-1] + 1))
    place = np.arange(at[-1] + 1) - np.repeat(first, lengths)
    long = np.flatnonzero(lengths > LONG_WORD)
    if len(long):
        place = np.minimum(place, LONG_WORD - 1)
    parts = _factors(int(min(LONG_WORD, lengths.max())))[place] * (folded[inside].astype(np.uint64) + np.uint64(1))
    whole = mix(np.add.reduceat(parts, first))
    for k in long:
        whole[k] = _long_hash(data[starts[k] : starts[k] + lengths[k]])
    begun = []
    if beginnings:
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(parts)])
        for k in beginnings:
            there = np.flatnonzero(lengths > k)
            begun.append((mix(sums[first[there] + k] - sums[first[there]] + np.uint64(k)), there))
    return whole, begun, starts


def _long_hash(word: np.ndarray) -> np.uint64:
    """The hash of a word of more than LONG_WORD bytes, read piece by piece."""
    h = hashlib.blake2b(digest_size=8)
    for k in range(0, len(word), BLOCK_BYTES):
        h.update(LOWER[word[k : k + BLOCK_BYTES]].tobytes())
    return np.uint64(int.from_bytes(h.digest(), "little"))


def _end_of_word(data: np.ndarray, at: int, keep: np.ndarray) -> int:
    """The first place from ``at`` on that is outside words."""
    while at < len(data):
        out = np.flatnonzero(~keep[LOWER[data[at : at + BLOCK_BYTES]]])
        if len(out):
            return at + int(out[0])
        at += BLOCK_BYTES
    return len(data)


def _start_of_word(data: np.ndarray, at: int, first: int, keep: np.ndarray) -> int:
    """The place behind the last one in [first, at) that is outside words."""
    out = np.flatnonzero(~keep[LOWER[data[first:at]]])
    return first + int(out[-1]) + 1 if len(out) else first


def word_parts(
    data: np.ndarray, offsets: np.ndarray, keep: np.ndarray, beginnings: tuple[int, ...] = ()
) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """64-bit hashes of the words of each row, A-Z lower-cased; for each length in
    ``beginnings`` the hashes of the longer words' first bytes with those words'
    places; and the words' row offsets.

    A word is a longest run of bytes in ``keep``.  Its hash is a sum of random
    factors times bytes (two words are equal with a chance below 2^-56), mixed.
    One long row is read piece by piece, cut between words, so that temporary
    arrays do not grow with it; words beyond LONG_WORD bytes are hashed as a stream.
    """
    if len(offsets) != 2 or len(data) <= 2 * BLOCK_BYTES:
        whole, begun, starts = _run_parts(data, offsets[1:-1], keep, beginnings)
        return whole, begun, np.searchsorted(starts, offsets)
    inner = np.zeros(0, np.int64)
    found, n, first = [], 0, 0
    begun: list[list] = [[] for _ in beginnings]
    pieces = []
    while first < len(data):
        cut = min(first + BLOCK_BYTES, len(data))
        end = _end_of_word(data, cut, keep) if cut < len(data) else cut
        if end - cut > LONG_WORD:
            # A long word lies across the cut: what is before it, then the word by itself.
            word = _start_of_word(data, cut, first, keep)
            pieces += [(first, word), (word, end)]
        else:
            pieces.append((first, end))
        first = end
    for lo, hi in pieces:
        if hi - lo > 2 * BLOCK_BYTES or (hi > lo and hi - lo > LONG_WORD and keep[LOWER[data[lo:hi]]].all()):
            whole = np.array([_long_hash(data[lo:hi])], np.uint64)
            more = []
            for k in beginnings:
                head = _factors(k)[:k] * (LOWER[data[lo : lo + k]].astype(np.uint64) + np.uint64(1))
                more.append((mix(np.array([head.sum(dtype=np.uint64) + np.uint64(k)])), np.zeros(1, int)))
        else:
            whole, more, _ = _run_parts(data[lo:hi], inner, keep, beginnings)
        for k, (hashes, there) in enumerate(more):
            begun[k].append((hashes, there + n))
        found.append(whole)
        n += len(whole)
    joined = [tuple(np.concatenate(c) for c in zip(*b, strict=True)) for b in begun]
    return np.concatenate(found), joined, np.array([0, n])


def hash_words(data: np.ndarray, offsets: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each row and the words' row offsets (see ``word_parts``)."""
    whole, _, rows = word_parts(data, offsets, keep)
    return whole, rows


def hash_bytes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes that ``offsets`` cut, none of them empty."""
    if len(offsets) < 2:
        return np.zeros(0, np.uint64)
    own = data[offsets[0] : offsets[-1]].astype(np.uint64) + np.uint64(1)
    first = offsets[:-1] - offsets[0]
    lengths = np.diff(offsets)
    place = np.arange(len(own)) - np.repeat(first, lengths)
    return mix(np.add.reduceat(_factors(int(lengths.max()))[place] * own, first))


def hash_terms(words: Iterable[str], keep: np.ndarray) -> np.ndarray:
    """Hashes of given words, as ``hash_words`` makes them."""
    raw = [w.encode() for w in words]
    offsets = np.cumsum([0, *map(len, raw)])
    hashes, rows = hash_words(np.frombuffer(b"".join(raw), np.uint8), offsets, keep)
    assert (np.diff(rows) == 1).all()
    return hashes
