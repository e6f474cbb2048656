"""Near-duplicate groups by a MinHash LSH forest.

Every document has a label per tree: min-hashes in a fixed order.  Rows of all
trees are sorted by (tree, label) over range partitions.  Candidates are the
neighbours in that order that share at least BASE hashes; where many rows share
those, neighbours share more, so the depth follows the crowd of a region.

What candidates connect is a family.  Candidates are confirmed on full sets, in
blocks of a family of bounded size, so a set travels once per block pair and not
once per pair.  What neighbours did not reach is made up for exactly: the
documents outside a family's largest component are compared with all of it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.llm.common import NOT_SPACE, hash_words, mix, text_blocks, widened
from paceline.llm.components import connected_components, local_roots
from paceline.session import materialize

#: Words in a shingle and links' least similarity in percent, unless a caller says otherwise.
SHINGLE, PERCENT = 5, 80

#: A document's min-hashes; BASE for each tree alone, the deeper ones shared between trees.
BASE, TREES = 4, 32
HASHES = BASE * TREES

#: Neighbours in the sorted order a row is compared with, on each side.
REACH = 4

#: Hashes of a label below BASE.
DEEPER = 4

#: Sketches hold a bit per min-hash.  At similarity 0.8 a tenth of the bits differ
#: (12.8 of 128, standard deviation 3.4); a pair is given up beyond 4.2 deviations.
MOST_DIFFERENT = 27

#: The most bits, as a power of two, of the filter of texts that are read again.
FILTER_BITS = 27

#: Sets of one family that are compared in one task, on each side.
BLOCK_SETS = 500

_A = mix(np.arange(1, HASHES + 1, dtype=np.uint64)).astype(np.uint32) | np.uint32(1)
_B = mix(np.arange(1001, HASHES + 1001, dtype=np.uint64)).astype(np.uint32)


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The set of each text's shingle hashes, sorted.  Fewer words than ``width``
    are one shingle; none give an empty set."""
    for first, end, data, offsets in text_blocks(texts):
        words, rows = hash_words(data, offsets, NOT_SPACE)
        for k in range(end - first):
            w = words[rows[k] : rows[k + 1]]
            n = len(w)
            if not n:
                yield np.zeros(0, np.uint64)
                continue
            m = max(1, n - width + 1)
            h = np.full(m, min(n, width), np.uint64)
            for j in range(min(n, width)):
                h = mix(h + w[j : j + m])
            yield np.unique(h)


def _digest(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def min_hashes(hashes: np.ndarray) -> np.ndarray:
    """HASHES minima of a set under as many permutations of 32-bit values."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 2048):
        np.minimum(low, (x[at : at + 2048, None] * _A + _B).min(axis=0), out=low)
    return low


def sign(docs: DataFrame, width: int) -> DataFrame:
    """row_key, doc_id, text_hash, n_shingles, digest (of the full set), hashes (HASHES x 2 bytes)."""

    def rows(batches):
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            size, digest, sig = [], [], []
            for s in shingle_sets(batch.column("text"), width):
                size.append(len(s))
                digest.append(_digest(s) if len(s) else None)
                sig.append(_scramble(min_hashes(s)).tobytes() if len(s) else None)
            keys = (part << 40) + n + np.arange(batch.num_rows)
            n += batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys, pa.int64()),
                    batch.column("doc_id"),
                    batch.column("text_hash"),
                    pa.array(size, pa.int64()),
                    pa.array(digest, pa.binary()),
                    pa.array(sig, pa.binary()),
                ],
                ["row_key", "doc_id", "text_hash", "n_shingles", "digest", "hashes"],
            )

    schema = "row_key bigint, doc_id bigint, text_hash bigint, n_shingles bigint, digest binary, hashes binary"
    slim = _slim(docs)
    return widened(docs.sparkSession, slim).mapInArrow(rows, schema)


def _slim(docs: DataFrame) -> DataFrame:
    """doc_id, text, text_hash; the hash tells the texts of a repeated doc_id apart."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("bigint"), text.alias("text"), F.xxhash64(text).alias("text_hash"))


def _scramble(low: np.ndarray) -> np.ndarray:
    """Minima are small numbers; mixed, every bit of them is as good as another.  16 bits are kept:
    different ones are taken for equal at 1 in 65,536, which only adds candidates."""
    return (mix(low.astype(np.uint64)) >> np.uint64(48)).astype(np.uint16)


def _sketches(hashes: np.ndarray) -> np.ndarray:
    """A bit of every hash of each row, as 64-bit numbers."""
    return np.packbits((hashes & 1).astype(np.uint8), axis=1).view(np.int64)


def forest_rows(classes: DataFrame) -> DataFrame:
    """TREES rows per class: key (tree and first BASE hashes), rest (the deeper ones), id, size, sketch."""

    def rows(batches):
        trees = np.arange(TREES, dtype=np.uint64)
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column("hashes").to_pylist()), np.uint16).reshape(-1, HASHES)
            n = len(sig)
            if not n:
                continue
            wide = sig.reshape(n, TREES, BASE).astype(np.uint64)
            key = np.broadcast_to(mix(trees), (n, TREES)).copy()
            for d in range(BASE):
                key = mix(key + wide[:, :, d])
            # The hashes below BASE are those of the next trees, one of each.
            rest = np.zeros((n, TREES), np.uint64)
            for d in range(DEEPER):
                rest = (rest << np.uint64(16)) | (np.roll(wide[:, :, d % BASE], -(d + 1), axis=1) & np.uint64(0xFFFF))
            bits = _sketches(sig)
            times = lambda c: np.repeat(c, TREES)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(key.ravel().view(np.int64)),
                    # As signed numbers in the order of the unsigned ones.
                    pa.array((rest.ravel() ^ np.uint64(1 << 63)).view(np.int64)),
                    pa.array(times(np.asarray(batch.column("id"))), pa.int64()),
                    pa.array(times(np.asarray(batch.column("n_shingles"))), pa.int64()),
                    *[pa.array(times(bits[:, k])) for k in range(HASHES // 64)],
                ],
                ["key", "rest", "id", "size", "s0", "s1"],
            )

    return classes.select("id", "n_shingles", "hashes").mapInArrow(
        rows, "key bigint, rest bigint, id bigint, size bigint, s0 bigint, s1 bigint"
    )


def neighbours(forest: DataFrame, percent: int) -> DataFrame:
    """Pairs (a < b) of rows up to REACH apart in the order of a tree, sharing its
    first BASE hashes, whose sizes and sketches allow the similarity.

    Rows are read as a stream, the last REACH carried over.  A partition also gives
    its first and last rows; together, in order, they show the pairs across borders.
    """
    names = ["key", "rest", "id", "size", "s0", "s1"]

    def pairs(columns: list[np.ndarray], since: int) -> np.ndarray:
        """Of the pairs whose later row is at ``since`` or behind it, the two ids."""
        key, _, ids, size, s0, s1 = columns
        found = [np.zeros((2, 0), np.int64)]
        for w in range(1, REACH + 1):
            i = np.flatnonzero(key[w:] == key[:-w])
            i = i[i + w >= since]
            ok = (ids[i] != ids[i + w]) & _may_link(size[i], size[i + w], s0[i] ^ s0[i + w], s1[i] ^ s1[i + w], percent)
            i = i[ok]
            found.append(np.stack([np.minimum(ids[i], ids[i + w]), np.maximum(ids[i], ids[i + w])]))
        return np.concatenate(found, axis=1)

    def batch_of(found: np.ndarray, border: list[np.ndarray] | None) -> pa.RecordBatch:
        found = np.unique(found, axis=1)
        n = found.shape[1]
        m = len(border[0]) if border else 0
        ends = [pa.array(np.append(x, np.zeros(m, np.int64)), mask=np.arange(n + m) >= n) for x in found]
        rows = [pa.array(np.append(np.zeros(n, np.int64), border[k] if m else []).astype(np.int64), mask=np.arange(n + m) < n) for k in range(6)]
        return pa.RecordBatch.from_arrays([*ends, *rows], ["a", "b", *names])

    def scan(batches):
        held, top = None, 0
        for batch in batches:
            now = [np.asarray(c) for c in batch.columns]
            if not len(now[0]):
                continue
            joined = [np.concatenate(c) for c in zip(held, now, strict=True)] if held else now
            carried = len(joined[0]) - len(now[0])
            first = [c[: max(0, REACH - top)] for c in now]
            top += len(first[0])
            yield batch_of(pairs(joined, carried), first)
            held = [c[-REACH:] for c in joined]
        if held:
            yield batch_of(np.zeros((2, 0), np.int64), held)

    def across(table: pa.Table) -> pa.Table:
        columns = [np.asarray(table[c]) for c in names]
        order = np.lexsort((columns[2], columns[1], columns[0]))
        # First and last rows of a small partition are the same ones.
        columns = [c[order] for c in columns]
        new = np.append(True, (np.diff(np.stack(columns[:3])) != 0).any(axis=0))
        a, b = pairs([c[new] for c in columns], 0)
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    parts = int(forest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # id in the order lets a hot label spread over partitions like any other rows.
    ordered = forest.repartitionByRange(parts, "key", "rest", "id").sortWithinPartitions("key", "rest", "id")
    schema = ", ".join(f"{c} bigint" for c in ("a", "b", *names))
    found = ordered.mapInArrow(scan, schema)
    found = materialize(found, "neighbours")
    # 2 * REACH rows of each partition, so one task can hold them.
    borders = found.filter("key is not null").select(*names).groupBy().applyInArrow(across, "a bigint, b bigint")
    return found.filter("a is not null").select("a", "b").union(borders).distinct()


def _may_link(m: np.ndarray, n: np.ndarray, x0: np.ndarray, x1: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of sizes m and n with sketches that differ in these bits may be similar enough."""
    fits = 100 * np.minimum(m, n) >= percent * np.maximum(m, n)
    apart = np.bitwise_count(x0.view(np.uint64)).astype(np.int16) + np.bitwise_count(x1.view(np.uint64))
    return fits & (apart <= MOST_DIFFERENT)


def _sets_of(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(id, shingles, s0, s1) of the classes in ``wanted`` (id, doc_id, text_hash, digest), from the
    texts of the rows that stand for them: those of that doc_id whose set has that digest."""

    def rows(batches):
        last = None
        for batch in batches:
            ids = batch.column("id").to_pylist()
            # Rows that repeat as a whole come one after the other; one of them is enough.
            fresh = np.array([i != j for i, j in zip(ids, [last, *ids], strict=False)], bool)
            last = ids[-1] if ids else last
            batch = batch.filter(pa.array(fresh))
            sets = list(shingle_sets(batch.column("text"), width))
            right = [_digest(s) == d for s, d in zip(sets, batch.column("digest").to_pylist(), strict=True)]
            sets = [s for s, ok in zip(sets, right, strict=True) if ok]
            hashes = np.array([_scramble(min_hashes(s)) for s in sets], np.uint16).reshape(-1, HASHES)
            bits = _sketches(hashes)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").filter(pa.array(right, pa.bool_())),
                    pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
                    pa.array(np.ascontiguousarray(bits[:, 0])),
                    pa.array(np.ascontiguousarray(bits[:, 1])),
                ],
                ["id", "shingles", "s0", "s1"],
            )

    texts = _perhaps(_slim(docs), wanted).join(wanted.hint("merge"), ["doc_id", "text_hash"])
    return texts.select("id", "text", "digest").mapInArrow(rows, "id bigint, shingles array<bigint>, s0 bigint, s1 bigint")


def _perhaps(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``texts`` that may be in ``wanted``, so that hardly any others are moved to meet it.

    A bit per hash of (doc_id, text_hash) is sent to every task: some 64 bits for a row, and
    2 ** FILTER_BITS (16 MB) at most.  Beyond 10 ** 8 rows it lets most through, and what
    follows is right all the same.
    """
    bits = 1 << min(FILTER_BITS, max(15, (64 * wanted.count()).bit_length()))
    place = F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(bits)) + 1
    bucket, bit = F.bitmap_bucket_number(place), F.bitmap_bit_position(place)
    maps = wanted.groupBy(bucket.alias("__bucket")).agg(F.bitmap_construct_agg(bit).alias("__map"))
    marked = texts.withColumn("__bucket", bucket).withColumn("__bit", bit)
    byte = "conv(hex(substring(__map, cast(__bit div 8 as int) + 1, 1)), 16, 10)"
    # bits / 32,768 rows of 4 KB.
    met = marked.join(F.broadcast(maps), "__bucket")
    return met.filter(f"getbit(cast({byte} as int), cast(__bit % 8 as int)) = 1").drop("__bucket", "__bit", "__map")


def _similar(pairs: pa.Table, sets: pa.Table, percent: int) -> pa.Table:
    """Stars over the pairs (a, b) whose full sets are similar enough."""
    ids = np.asarray(sets["id"])
    order = np.argsort(ids)
    column = sets["shingles"].combine_chunks()
    ends = np.asarray(column.offsets)
    _, values = np.unique(np.asarray(column.flatten()), return_inverse=True)
    start, n = (ends[:-1] - ends[0])[order], np.diff(ends)[order]
    a = np.searchsorted(ids[order], np.asarray(pairs["a"]))
    b = np.searchsorted(ids[order], np.asarray(pairs["b"]))
    common, marked = np.zeros(len(a), np.int64), np.zeros(values.max(initial=0) + 1, bool)
    by = np.argsort(a, kind="stable")
    for part in np.split(by, np.flatnonzero(np.diff(a[by])) + 1):
        if not len(part):
            continue
        own = slice(start[a[part[0]]], start[a[part[0]]] + n[a[part[0]]])
        marked[values[own]] = True
        first = np.cumsum(n[b[part]]) - n[b[part]]
        places = np.arange(n[b[part]].sum()) + np.repeat(start[b[part]] - first, n[b[part]])
        common[part] = np.add.reduceat(marked[values[places]].astype(np.int64), first)
        marked[values[own]] = False
    ok = 100 * common >= percent * (n[a] + n[b] - common)
    u, v = local_roots(np.asarray(pairs["a"])[ok], np.asarray(pairs["b"])[ok])
    return pa.table({"a": u, "b": v})


def families(pairs: DataFrame) -> DataFrame:
    """(node, family, block, blocks): what candidates connect, cut into blocks of about BLOCK_SETS."""
    found = connected_components(pairs)
    # Only the large ones meet their sizes; those are few.
    large = found.groupBy("component").count().filter(F.col("count") > BLOCK_SETS)
    blocks = F.coalesce(F.ceil(F.col("count") / F.lit(BLOCK_SETS)).cast("int"), F.lit(1))
    placed = found.join(large, "component", "left").withColumn("blocks", blocks)
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block")
    return materialize(placed.select("node", F.col("component").alias("family"), block, "blocks"), "families")


def confirm(pairs: DataFrame, family: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect what the pairs with similar enough full sets connect."""
    a = family.select(F.col("node").alias("a"), "family", F.col("block").alias("block_a"))
    b = family.select(F.col("node").alias("b"), F.col("block").alias("block_b"))
    low, high = F.least("block_a", "block_b").alias("low"), F.greatest("block_a", "block_b").alias("high")
    keyed = materialize(pairs.join(a, "a").join(b, "b").select("family", low, high, "a", "b"), "pairs")
    ends = keyed.selectExpr("family as f", "low as l", "high as h", "explode(array(a, b)) as id").distinct()
    return (
        keyed.groupBy("family", "low", "high")
        .cogroup(ends.join(sets.select("id", "shingles"), "id").groupBy("f", "l", "h"))
        .applyInArrow(lambda p, s: _similar(p, s, percent), "a bigint, b bigint")
    )


def leftovers(family: DataFrame, parts: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links from the documents outside their family's largest component to any of the family.

    Both sides are cut into blocks; a task holds one block of each.
    """
    component = F.coalesce("component", "node").alias("component")
    placed = family.join(parts, "node", "left").select("node", "family", "block", "blocks", component)
    placed = materialize(placed, "placed")
    per = placed.groupBy("family", "component").count()
    main = per.groupBy("family").agg(
        F.max_by("component", F.struct("count", "component")).alias("main"),
        F.sum("count").alias("all"),
        F.max("count").alias("most"),
    )
    main = main.filter("all > most").withColumn("outside", F.ceil((F.col("all") - F.col("most")) / F.lit(BLOCK_SETS)).cast("int"))
    here = placed.join(main, "family").withColumn("side", F.pmod(F.xxhash64("node", F.lit(1)), F.col("outside")).cast("int"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    x = here.filter("component <> main").select("family", F.col("side").alias("x"), every("blocks").alias("y"), "node", "component")
    y = here.select("family", every("outside").alias("x"), F.col("block").alias("y"), "node", "component")

    def near(left: pa.Table, right: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Places (left, right) of pairs of different components that size and sketch leave open."""
        (c, m, u0, u1), (d, n, v0, v1) = ([np.asarray(t[k]) for k in ("component", "size", "s0", "s1")] for t in (left, right))
        found = [np.zeros((2, 0), np.int64)]
        for i in range(len(c)):
            j = np.flatnonzero((d != c[i]) & _may_link(n, m[i], v0 ^ u0[i], v1 ^ u1[i], percent))
            found.append(np.stack([np.full(len(j), i), j]))
        i, j = np.concatenate(found, axis=1)
        return i, j

    def open_ones(left: pa.Table, right: pa.Table) -> pa.Table:
        i, j = near(left, right)
        columns = [*names, "side"]
        return pa.concat_tables([t.rename_columns(columns).take(np.unique(k)) for t, k in ((left, i), (right, j))])

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        i, j = near(left, right)
        both = pa.concat_tables([t.select(["node", "shingles"]) for t in (left, right)])
        _, once = np.unique(np.asarray(both["node"]), return_index=True)
        pairs = pa.table({"a": left["node"].take(i), "b": right["node"].take(j)})
        return _similar(pairs, both.take(once).rename_columns(["id", "shingles"]), percent)

    # Sketches meet first; sets are moved only where a pair is left open.
    size = F.size("shingles").cast("bigint").alias("size")
    sketches = sets.select(F.col("id").alias("node"), size, "s0", "s1")
    names = ["family", "x", "y", "node", "component", "size", "s0", "s1"]
    # Columns of both sides get names of their own, for the two may come from one table.
    apart = lambda t, k, names: t.toDF(*(f"{c}_{k}" if c in ("family", "x", "y") else c for c in names))
    by = lambda t, k: t.groupBy(f"family_{k}", f"x_{k}", f"y_{k}")
    sides = [apart(t.join(sketches, "node").select(*names, F.lit(k).alias("side")), k, [*names, "side"]) for k, t in enumerate((x, y))]
    schema = "family bigint, x int, y int, node bigint, component bigint, size bigint, s0 bigint, s1 bigint, side int"
    still = by(sides[0], 0).cogroup(by(sides[1], 1)).applyInArrow(open_ones, schema)
    still = materialize(still, "open").join(sets.select(F.col("id").alias("node"), "shingles"), "node")
    halves = [apart(t, k, t.columns) for k, t in enumerate(still.filter(F.col("side") == k).select(*names[:5], "shingles", *names[5:]) for k in (0, 1))]
    return by(halves[0], 0).cogroup(by(halves[1], 1)).applyInArrow(compare, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Words are runs without white space, A-Z lower-cased.  Texts whose sets of
    ``width``-word shingles have 100 * intersection >= percent * union are
    linked; ``component_id`` is the smallest doc_id that links lead to, and
    ``kept`` marks the row that has it.  Texts with no word (null, empty) link
    with nothing.  Rows that repeat a doc_id are one document, whatever their
    texts: what one of them links to, all do, and all are marked alike.  A row
    without a doc_id is linked with nothing, has no component, and is kept.
    """
    signed = materialize(sign(docs, width), "signed")
    known = signed.filter("doc_id is not null and digest is not null")
    # Equal sets form a class; its smallest row_key is its id, and that row stands for it.
    first = F.min(F.struct("row_key", "doc_id", "text_hash", "n_shingles", "hashes")).alias("first")
    classes = materialize(
        known.groupBy("digest").agg(first, F.min("doc_id").alias("least")).select("digest", "least", F.col("first.row_key").alias("id"), "first.*").drop("row_key"),
        "classes",
    )
    named = classes.select("digest", "id", "least")
    member = materialize(known.select("row_key", "doc_id", "n_shingles", "digest").join(named, "digest").drop("digest"), "members")
    pairs = materialize(neighbours(forest_rows(classes), percent), "candidates")
    family = families(pairs)
    wanted = family.select(F.col("node").alias("id")).join(classes.select("id", "doc_id", "text_hash", "digest"), "id")
    sets = materialize(_sets_of(docs, wanted, width), "sets")
    links = materialize(confirm(pairs, family, sets, percent), "links")
    more = leftovers(family, connected_components(links), sets, percent)

    # The rows of a doc_id are one document, whatever their texts: its classes are linked, rows without a word follow them.
    wordless = signed.filter("doc_id is not null and digest is null").select("row_key", "doc_id")
    nothing = F.lit(None).cast("bigint")
    repeated = (
        member.select("doc_id", "id", "least")
        .union(wordless.select("doc_id", nothing, nothing))
        .groupBy("doc_id")
        .agg(F.min(F.when(F.col("id").isNotNull(), F.struct("id", "least"))).alias("first"), F.max("id").alias("last"), F.count(F.lit(1)).alias("rows"), F.count("id").alias("worded"))
        .filter("first.id < last or worded > 0 and worded < rows")
    )
    repeated = materialize(repeated.select("doc_id", F.col("first.id").alias("a"), F.col("first.least").alias("least")), "repeated")
    same = member.select("doc_id", "id").join(repeated, "doc_id").filter("id <> a").select("a", F.col("id").alias("b")).distinct()
    parts = connected_components(links.union(materialize(more, "links")).union(same))

    # A component has the smallest doc_id of its classes.
    found = parts.join(classes.select(F.col("id").alias("node"), "least"), "node")
    named = found.join(found.groupBy("component").agg(F.min("least").alias("named")), "component").select("node", "named")
    rows = member.select("row_key", "id", "least").union(wordless.join(repeated, "doc_id").select("row_key", "a", "least"))
    linked = rows.join(named, F.col("id") == F.col("node"), "left").select(
        "row_key", F.coalesce("named", "least").alias("class_component")
    )
    component = F.coalesce("class_component", "doc_id")
    return (
        signed.select("row_key", "doc_id", "n_shingles")
        .join(linked, "row_key", "left")
        .select(
            "doc_id",
            "n_shingles",
            component.alias("component_id"),
            F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"),
        )
    )


def deduplicate(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs`` without the rows of each group but the one with its smallest doc_id.

    Rows that repeat that doc_id are one document and stay; so do rows without one.
    """
    gone = near_duplicates(docs, width, percent).filter("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("bigint") == F.col("__gone"), "left_anti")
