"""Phrases that stand together more often than their parts do.

Suffix pointers, the places where a phrase of up to four words may begin, are
routed over the cluster by hashes of their two leading words.  A task sorts what
it gets by multikey three-way quicksort to the depth of four words: the size of an
equal partition is the count of the phrase its words spell, and a partition that
is smaller than the least count is left unsorted.

Bins of two and of three leading words are counted first.  Small ones share a task.
One with more suffixes than a task should hold is cut by its third word, and where
three words alone are too many, by the fourth; the counts of what a cut goes through
are summed over the pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceline.llm.common import LOWER, hash_bytes, mix, text_blocks, widened
from paceline.session import materialize

#: Words in a phrase at most, its least count, and the share (in percent) of its
#: occurrences that lie in one longer phrase from which on it is part of that.
LONGEST, LEAST, INSIDE = 4, 30, 80

#: Phrases reported for each language.
TOP = 2000

#: Hash bins of leading pairs and of triples, and the suffixes a task should get.  The bins are
#: counted on the driver, so their number bounds what is sent there (16 bytes each).
#: With some 100,000 words a bin or more, raise it: results do not depend on it.
BINS, SUFFIXES = 1 << 16, 500_000

#: Partitions of fewer suffixes are sorted whole instead of being parted further.
SMALL = 2048

#: Words a task turns into suffixes at a time; equal suffixes among them are one row.
WORDS = 600_000

#: Partial top lists of a language before the last one.
SPREAD = 64

_BREAK = np.zeros(256, bool)
_BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
_OUTSIDE = _BREAK.copy()
_OUTSIDE[list(b" \t")] = True


def _language(lang: Column) -> Column:
    return F.coalesce(lang.cast("string"), F.lit("und"))


def _read(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, list[str]]]:
    """Runs of about ``words`` words: the words in use (as bytes), each word's number
    among them, its piece, its language's number, and the languages.

    Pieces never cross texts, so a word's piece tells its text too.
    """
    tongues: dict[str, int] = {}
    parts, pieces, langs, n, piece = [], [], [], 0, 0

    def run():
        joined = pa.concat_arrays(parts).dictionary_encode()
        return joined.dictionary, np.asarray(joined.indices), np.concatenate(pieces), np.concatenate(langs), list(tongues)

    for batch in batches:
        own = np.array([tongues.setdefault(x, len(tongues)) for x in batch.column("lang").to_pylist()], np.int32)
        for first, end, data, offsets in text_blocks(batch.column("text")):
            if not len(data):
                continue
            folded = LOWER[data]
            inside = ~_OUTSIDE[folded]
            # A text ends a piece like a sign does.
            begins = np.zeros(len(data), bool)
            inner = offsets[:-1][np.diff(offsets) > 0]
            begins[inner] = True
            starts = inside.copy()
            starts[1:] &= ~inside[:-1] | begins[1:]
            at = np.flatnonzero(starts)
            if not len(at):
                continue
            breaks = np.cumsum(_BREAK[folded] | begins)
            kept = np.cumsum(inside)
            ends = np.append(kept[at] - 1, kept[-1])
            parts.append(
                pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(folded[inside])])
            )
            pieces.append(piece + breaks[at])
            langs.append(own[first:end][np.searchsorted(offsets, at, side="right") - 1])
            piece += int(breaks[-1])
            n += len(at)
            if n >= words:
                yield run()
                parts, pieces, langs, n = [], [], [], 0
    if n:
        yield run()


def _suffixes(codes: np.ndarray, pieces: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, words): the words from each place on that has a second one in its piece; -1 beyond the piece."""
    n = len(codes)
    rows = np.full((n, longest), -1, np.int32)
    rows[:, 0] = codes
    for d in range(1, min(longest, n)):
        same = pieces[d:] == pieces[:-d]
        rows[:-d, d] = np.where(same, codes[d:], -1)
    at = np.flatnonzero(rows[:, 1] >= 0)
    return at, rows[at]


def _bytes_of(values: pa.Array) -> bytes:
    """The bytes of all values, end to end."""
    ends = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    return values.buffers()[2][int(ends[0]) : int(ends[-1])].to_pybytes()


def _unpacked(packed: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(packed)


def _prefix_hashes(lang: np.ndarray, words: np.ndarray, hashes: np.ndarray, lang_hashes: np.ndarray) -> list[np.ndarray]:
    """Hashes of each suffix's language with its first two words, first three, and so on."""
    hashes = np.append(hashes, np.uint64(0))
    h = mix(lang_hashes[lang] + hashes[words[:, 0]])
    out = []
    for d in range(1, words.shape[1]):
        h = mix(h + hashes[words[:, d]])
        out.append(h)
    return out


def _hash_words(words: pa.Array) -> np.ndarray:
    return hash_bytes(np.frombuffer(words.buffers()[2], np.uint8), np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1])


def _hash_langs(langs: list[str]) -> np.ndarray:
    return _hash_words(pa.array([b"#" + x.encode() for x in langs], pa.large_binary()))


def count_words(docs: DataFrame, longest: int, bins: int = BINS) -> DataFrame:
    """(lang, word, bin, c): the count of each word, and the suffixes in each bin (with neither lang nor
    word) of leading pairs, from 0, and of leading triples, from ``bins``."""

    def rows(batches):
        in_bin = np.zeros(2 * bins, np.int64)
        for words, codes, pieces, lang, langs in _read(batches, WORDS):
            keys, c = np.unique(lang.astype(np.int64) * len(words) + codes, return_counts=True)
            for k in range(0, len(keys), 50_000):
                part = keys[k : k + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(langs, pa.string()).take(pa.array(part // len(words))),
                        words.take(pa.array(part % len(words))).cast(pa.large_string()).cast(pa.string()),
                        pa.nulls(len(part), pa.int32()),
                        pa.array(c[k : k + 50_000]),
                    ],
                    ["lang", "word", "bin", "c"],
                )
            at, suffixes = _suffixes(codes, pieces, longest)
            hashes = _prefix_hashes(lang[at], suffixes, _hash_words(words), _hash_langs(langs))
            for k, h in enumerate(hashes[:2]):
                in_bin += np.bincount((h % np.uint64(bins)).astype(np.int64) + k * bins, minlength=2 * bins)
        used = np.flatnonzero(in_bin)
        # A batch of the bins of the whole task.
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(len(used), pa.string()), pa.nulls(len(used), pa.string()), pa.array(used, pa.int32()), pa.array(in_bin[used])],
            ["lang", "word", "bin", "c"],
        )

    counted = docs.mapInArrow(rows, "lang string, word string, bin int, c bigint")
    return counted.groupBy("lang", "word", "bin").agg(F.sum("c").alias("c"))


def routes(sizes: np.ndarray, suffixes: int = SUFFIXES) -> tuple[np.ndarray, np.ndarray]:
    """(route, cuts) of each bin: bins in a row share a route while they fit, one too large is cut."""
    cuts = np.maximum(1, -(-sizes // suffixes))
    route = np.zeros(len(sizes), np.int64)
    now, held = 0, 0
    for k, n in enumerate(sizes.tolist()):
        if held and (held + n > suffixes):
            now, held = now + 1, 0
        route[k] = now
        held += n
    return route, cuts


def route_suffixes(docs: DataFrame, sizes: np.ndarray, longest: int, suffixes: int = SUFFIXES) -> DataFrame:
    """(route, cut, whole, langs, words, n, codes): blocks of ``n`` suffixes with the words they use.

    ``codes`` holds a column per word of the suffixes (0 where there is none, else 1 +
    the place in ``words``, each with a line end), before them one of languages and after
    them one of counts; both are compressed.  ``sizes``: of the bins of pairs, then of
    triples.  All suffixes that share their first ``whole`` words are in one piece.
    """
    bins = len(sizes) // 2
    route, cuts = routes(sizes[:bins], suffixes)
    deeper = np.maximum(1, -(-sizes[bins:] // suffixes))
    most = int(cuts.max(initial=1)) * (1 + int(deeper.max(initial=1)))

    def rows(batches):
        pack = zstandard.ZstdCompressor(level=1).compress
        for words, codes, pieces, lang, langs in _read(batches, WORDS):
            at, suffix = _suffixes(codes, pieces, longest)
            if not len(at):
                continue
            lang, hashes = lang[at], _hash_words(words)
            lines = pc.binary_join_element_wise(words, pa.scalar(b"", words.type), pa.scalar(b"\n", words.type))
            by = _prefix_hashes(lang, suffix, hashes, _hash_langs(langs))
            b, triple, h = (by[0] % np.uint64(bins)).astype(np.int64), (by[min(1, longest - 2)] % np.uint64(bins)).astype(np.int64), by[-1]
            parted = cuts[b] > 1
            again = parted & (deeper[triple] > 1)
            high = lambda x, n: ((x >> np.uint64(24)) % n.astype(np.uint64)).astype(np.int64)
            cut = np.where(parted, high(by[min(1, longest - 2)], cuts[b]), 0) * (1 + int(deeper.max()))
            cut += np.where(again, 1 + high(h, deeper[triple]), 0)
            whole = 2 + parted.astype(np.int64) + again
            # By target, in it by hash: equal suffixes lie together, but for colliding hashes,
            # which leave them apart and the counts right.
            target = route[b] * most + cut
            _, rank = np.unique(target, return_inverse=True)
            order = np.argsort((rank.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
            suffix, lang, target = suffix[order], lang[order], target[order]
            new = np.ones(len(order), bool)
            new[1:] = (suffix[1:] != suffix[:-1]).any(axis=1) | (lang[1:] != lang[:-1]) | (target[1:] != target[:-1])
            first = np.flatnonzero(new)
            times = np.diff(np.append(first, len(order)))
            suffix, lang, target = suffix[first], lang[first], target[first]
            b, cut, whole = b[order[first]], cut[order[first]], whole[order[first]]
            seen, place = np.zeros(len(words) + 1, bool), np.zeros(len(words) + 1, np.int64)
            edges = np.flatnonzero(np.append(True, target[1:] != target[:-1]))
            for lo, hi in zip(edges, np.append(edges[1:], len(target)), strict=True):
                of = suffix[lo:hi] + 1
                seen[:] = False
                seen[of] = True
                used = np.flatnonzero(seen[1:])
                place[used + 1] = np.arange(1, len(used) + 1)
                local = place[of]
                table = np.column_stack([lang[lo:hi], local, times[lo:hi]])
                kind = np.uint16 if table.max() < 1 << 16 else np.uint32
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([int(route[b[lo]])]),
                        pa.array([int(cut[lo])]),
                        pa.array([int(whole[lo])]),
                        pa.array([langs], pa.list_(pa.string())),
                        pa.array([pack(_bytes_of(lines.take(pa.array(used))))], pa.binary()),
                        pa.array([hi - lo], pa.int64()),
                        pa.array([pack(np.ascontiguousarray(table.T.astype(kind)).tobytes())], pa.binary()),
                    ],
                    ["route", "cut", "whole", "langs", "words", "n", "codes"],
                )

    schema = "route bigint, cut bigint, whole bigint, langs array<string>, words binary, n bigint, codes binary"
    return docs.mapInArrow(rows, schema)


def equal_partitions(codes: np.ndarray, weights: np.ndarray, least: list[int]) -> Iterator[tuple[int, int, int]]:
    """(depth, row, count) of every equal partition: the rows that agree with ``row`` in
    their first ``depth`` columns weigh ``count``, at least ``least[depth - 1]``.

    Multikey three-way quicksort: rows are dealt by the column at hand into smaller than,
    equal to and larger than its median; the equal ones go on with the next column.
    Zero is the end of a row.  Partitions below the least count are abandoned, small ones
    sorted whole.
    """
    depth = codes.shape[1]
    todo = [(np.arange(len(codes)), 0)]
    while todo:
        rows, d = todo.pop()
        if len(rows) < SMALL:
            yield from _sorted_whole(codes, weights, least, rows, d)
            continue
        keys = codes[rows, d]
        pivot = np.partition(keys, len(keys) // 2)[len(keys) // 2]
        for side in (keys < pivot, keys > pivot):
            part = rows[side]
            if len(part) and weights[part].sum() >= least[d]:
                todo.append((part, d))
        same = rows[keys == pivot]
        if pivot and (count := int(weights[same].sum())) >= least[d]:
            yield d + 1, int(same[0]), count
            if d + 1 < depth:
                todo.append((same, d + 1))


def _sorted_whole(codes: np.ndarray, weights: np.ndarray, least: list[int], rows: np.ndarray, d: int) -> Iterator[tuple[int, int, int]]:
    """As ``equal_partitions``, of rows that agree before column ``d``: sorted, equal runs of each depth counted."""
    for k in range(d, codes.shape[1]):
        # What does not go on, or is too rare already, is left behind.
        rows = rows[codes[rows, k] > 0]
        if not len(rows):
            return
        rows = rows[np.lexsort(codes[rows, d : k + 1].T[::-1])]
        own = codes[rows, d : k + 1]
        first = np.flatnonzero(np.append(True, (own[1:] != own[:-1]).any(axis=1)))
        counts = np.add.reduceat(weights[rows], first)
        enough = counts >= least[k]
        for at, n in zip(rows[first[enough]].tolist(), counts[enough].tolist(), strict=True):
            yield k + 1, at, n
        rows = rows[np.repeat(enough, np.diff(np.append(first, len(rows))))]


def _count_route(table: pa.Table, least: int, longest: int) -> pa.Table:
    """(lang, phrase, size, c) of the phrases of two words or more in a route's suffixes."""
    tongues: dict[str, int] = {}
    columns, words = [], []
    for langs, n, packed in zip(table["langs"].to_pylist(), table["n"].to_pylist(), table["codes"].to_pylist(), strict=True):
        raw = _unpacked(packed)
        flat = np.frombuffer(raw, np.uint16 if len(raw) == 2 * n * (longest + 2) else np.uint32).reshape(longest + 2, n)
        own = np.array([tongues.setdefault(x, len(tongues) + 1) for x in langs], np.int32)
        columns.append(np.vstack([own[flat[0]], flat[1:].astype(np.int32)]))
    # Words of all blocks get one numbering; 0 stays the end of a suffix.  Each keeps its line end.
    for packed in table["words"].to_pylist():
        raw = _unpacked(packed)
        ends = np.append(0, np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1)
        words.append(pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(raw)]))
    start = np.cumsum([0, *map(len, words)])
    words = pa.concat_arrays(words).dictionary_encode()
    number = np.asarray(words.indices) + np.int32(1)
    for k, c in enumerate(columns):
        lookup = np.append(np.int32(0), number[start[k] : start[k + 1]])
        c[1:-1] = lookup[c[1:-1]]
    codes = np.ascontiguousarray(np.hstack(columns).T)
    weights, codes = codes[:, -1].astype(np.int64), codes[:, :-1]
    # Of shorter phrases than are whole here there may be more elsewhere, so none is abandoned.
    whole = table["whole"][0].as_py()
    bounds = [1, *(least if d >= whole or whole == 2 else 1 for d in range(1, longest + 1))]
    found = [(d - 1, r, c) for d, r, c in equal_partitions(codes, weights, bounds) if d > 2]
    names = list(tongues)
    used = np.unique(np.concatenate([codes[r, 1 : d + 1] for d, r, _ in found])) if found else np.zeros(0, np.int32)
    spelt = dict(zip(used.tolist(), words.dictionary.take(pa.array(used - 1)).to_pylist(), strict=True))
    return pa.table(
        {
            "lang": pa.array([names[codes[r, 0] - 1] for _, r, _ in found], pa.string()),
            "phrase": pa.array([b" ".join(spelt[w][:-1] for w in codes[r, 1 : d + 1].tolist()).decode() for d, r, _ in found], pa.string()),
            "size": pa.array([d for d, _, _ in found], pa.int32()),
            "c": pa.array([c for _, _, c in found], pa.int64()),
        }
    )


def phrase_counts(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, bins: int = BINS, suffixes: int = SUFFIXES) -> tuple[DataFrame, DataFrame]:
    """(phrases, totals): (lang, phrase, size, a) of the phrases of up to ``longest`` words that
    occur ``least`` times or more in their language, and (lang, n) with all its words."""
    slim = docs.select(_language(F.col("lang")).alias("lang"), F.col("text").cast("string").alias("text"))
    slim = widened(docs.sparkSession, slim)
    counted = materialize(count_words(slim, longest, bins), "words")
    sizes = np.zeros(2 * bins, np.int64)
    for row in counted.filter("bin is not null").select("bin", "c").collect():
        sizes[row["bin"]] = row["c"]
    words = counted.filter("bin is null")
    blocks = route_suffixes(slim, sizes, longest, suffixes)
    longer = blocks.groupBy("route", "cut").applyInArrow(
        lambda t: _count_route(t, least, longest), "lang string, phrase string, size int, c bigint"
    )
    # The pieces of a bin that was cut hold shares of its shorter phrases.
    longer = longer.groupBy("lang", "phrase", "size").agg(F.sum("c").alias("a"))
    one = words.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("size"), F.col("c").alias("a"))
    phrases = materialize(one.union(longer).filter(F.col("a") >= least), "phrases")
    return phrases, words.groupBy("lang").agg(F.sum("c").alias("n"))


def collocations(
    docs: DataFrame, least: int = LEAST, inside: int = INSIDE, top: int = TOP, longest: int = LONGEST, bins: int = BINS, suffixes: int = SUFFIXES
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases of 2 to ``longest`` words.

    A-Z are lower-cased; words are runs without space and tab between the signs
    ``. , ; : ! ?`` and line ends.  All counts are of one language (null: ``und``) over
    whole texts: ``a`` of the phrase, ``l`` and ``r`` of what its weakest cut leaves to the
    left and right, ``n`` of all words; score = floor(2000000 a / (l + r)), of equal cuts
    the leftmost.  Phrases that occur less than ``least`` times are none; those of which
    ``inside`` percent or more stand in one longer phrase are left out.  Order: score
    and ``a`` descending, then the phrase by its bytes.  Null and empty texts have no
    words; repeated rows count each; other columns are not read.
    """
    phrases, totals = phrase_counts(docs, least, longest, bins, suffixes)
    words = F.split("phrase", " ")
    part = lambda first, n: F.array_join(F.slice(words, first, n), " ")
    longer = phrases.filter("size > 1")
    cut = longer.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cut = cut.select("lang", "phrase", "size", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    known = phrases.select("lang", "phrase", "a")
    cut = cut.join(known.toDF("lang", "left", "l"), ["lang", "left"]).join(known.toDF("lang", "right", "r"), ["lang", "right"])
    # Counts may pass 64 bits once multiplied.
    score = F.expr("cast(a as decimal(20, 0)) * 2000000 div (cast(l as decimal(20, 0)) + r)")
    weakest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("weakest")
    scored = cut.groupBy("lang", "phrase").agg(weakest)

    spans = [(i, n) for n in range(2, longest) for i in range(1, longest - n + 2)]
    held = F.array(F.lit(None).cast("string"), *[F.when((F.size(words) > n) & (F.size(words) >= i + n - 1), part(F.lit(i), F.lit(n))) for i, n in spans])
    within = longer.filter("size > 2").select("lang", F.explode(held).alias("phrase"), F.col("a").alias("more"))
    within = within.filter("phrase is not null").groupBy("lang", "phrase").agg(F.max("more").alias("more"))
    part_of = F.col("more").isNotNull() & (F.col("more").cast("decimal(20, 0)") * 100 >= F.col("a").cast("decimal(20, 0)") * inside)
    candidates = longer.join(within, ["lang", "phrase"], "left").filter(~part_of).select("lang", "phrase", "a").join(scored, ["lang", "phrase"])
    candidates = candidates.select("lang", "phrase", "a", "weakest.l", "weakest.r", "weakest.score")

    # Top lists of shares of a language first, so the last list is short.
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    share = F.pmod(F.xxhash64("phrase"), F.lit(SPREAD))
    few = candidates.withColumn("share", share)
    few = few.withColumn("place", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).filter(F.col("place") <= top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")
    ranked = few.withColumn("rank", rank).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
