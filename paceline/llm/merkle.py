"""A Merkle manifest of a table, with proofs by octopus multiproofs.

Each row is a leaf of its language's tree; the roots of those trees are leaves of
the top tree.  Leaves are numbered in order without a global sort into one task,
nodes are built block by block: a task holds WIDE leaves and gives all nodes above
them, the blocks' own roots are the leaves of the next round.

Proofs are made per leaf partition, not per leaf.  A partition finds which nodes
its leaves lack, each counted once and none that it can compute itself; fetches
those in one join; derives all nodes that its proofs share; and writes each leaf's
own proof out from what it then holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceline.session import materialize

#: Children of a node.
ARITY = 2

#: Leaves of one building block: a power of ARITY.  A task holds their nodes.
WIDE = 1 << 14

#: Leaves of one proof partition.
PART = 1 << 14

#: Partitions that fetch one copy of a node; nodes wanted by more are copied.
FETCHERS = 1_000

#: Rows of one tree, whose leaves are the roots of all others.
TOP = -1


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(*columns: Column) -> Column:
    """The leaf of a row: of every value its bytes in UTF-8, their number before it, ``-`` for null."""
    parts = []
    for c in columns:
        text = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def numbered(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``place``: their number in their group, from 0, in this order.

    Rows are range-partitioned and sorted inside partitions; a place is that in the
    partition plus the rows of the group in earlier ones.  Rows equal in all of
    ``order`` are dealt by chance, so a hot value spreads.
    """
    rows = rows.withColumn("__deal", F.xxhash64(F.monotonically_increasing_id()))
    keys = [F.col(c) for c in (group, *order, "__deal")]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__deal")
    dealt = materialize(dealt.withColumn("__at", F.monotonically_increasing_id()), name)
    part = F.shiftright("__at", 33).alias("__part")
    runs = dealt.groupBy(group, part).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
    runs = runs.select(F.col(group).alias("__group"), F.col("__part").alias("__p"), (F.col("__before") - F.col("__first")).alias("__shift"))
    on = F.col(group).eqNullSafe(F.col("__group")) & (F.shiftright("__at", 33) == F.col("__p"))
    return dealt.join(runs, on).withColumn("place", F.col("__at") + F.col("__shift")).drop("__at", "__group", "__p", "__shift")


def levels(leaves: int, arity: int = ARITY) -> list[int]:
    """The number of nodes of each level, leaves first, one node last."""
    out = [leaves]
    while out[-1] > 1:
        out.append(-(-out[-1] // arity))
    return out


def raised(hashes: list[str], arity: int) -> list[str]:
    return [digest("".join(hashes[k : k + arity])) for k in range(0, len(hashes), arity)]


_NODES = "tree bigint, level int, place bigint, hash string, n bigint"


def build(leaves: DataFrame, arity: int = ARITY, wide: int = WIDE) -> DataFrame:
    """(tree, level, place, hash, n) of all nodes of the trees with these leaves (tree, place, hash,
    and ``n``, the leaves of the tree).

    While many nodes of a level remain, every ``arity`` of them in a row have a parent, the
    last ones too if they are fewer.  Rounds grow with the logarithm of the leaves to the base ``wide``.
    """
    height = next(h for h in range(1, 64) if arity**h >= wide)
    wide = arity**height
    now = leaves.select("tree", F.lit(0).alias("level"), "place", "hash", "n")
    out, base = now, 0

    def up(table: pa.Table) -> pa.Table:
        order = np.argsort(np.asarray(table["place"]))
        hashes = table["hash"].take(pa.array(order)).to_pylist()
        tree, leaves = table["tree"][0].as_py(), table["n"][0].as_py()
        level, place = table["level"][0].as_py(), table["place"][int(order[0])].as_py()
        # Nodes the level has in all: a single one is the root.
        n = -(-leaves // arity**level)
        got: tuple[list, list, list] = ([], [], [])
        for _ in range(height):
            if n <= 1:
                break
            hashes, n, level, place = raised(hashes, arity), -(-n // arity), level + 1, place // arity
            got[0].extend([level] * len(hashes))
            got[1].extend(range(place, place + len(hashes)))
            got[2].extend(hashes)
        return pa.table(
            {
                "tree": pa.array([tree] * len(got[0]), pa.int64()),
                "level": pa.array(got[0], pa.int32()),
                "place": pa.array(got[1], pa.int64()),
                "hash": pa.array(got[2], pa.string()),
                "n": pa.array([leaves] * len(got[0]), pa.int64()),
            }
        )

    while True:
        made = now.withColumn("block", F.floor(F.col("place") / F.lit(wide)).cast("bigint")).groupBy("tree", "block").applyInArrow(up, _NODES)
        made = materialize(made, "nodes")
        out, base = out.union(made), base + height
        # Blocks of a tree whose root is not reached yet go on.
        now = made.filter((F.col("level") == base) & (F.col("n") > arity**base))
        if now.isEmpty():
            return out


def missing(known: Iterable[int], sizes: list[int], arity: int = ARITY) -> list[tuple[int, int]]:
    """The least (level, place) of nodes that, with the known leaves, give all their proofs: of each
    level the siblings that are neither known nor derived from known ones."""
    out, now = [], sorted(set(known))
    for level, n in enumerate(sizes[:-1]):
        held = set(now)
        parents = sorted({p // arity for p in now})
        out += [(level, c) for p in parents for c in range(p * arity, min(n, (p + 1) * arity)) if c not in held]
        now = parents
    return out


def derive(leaves: dict[int, str], fetched: dict[tuple[int, int], str], sizes: list[int], arity: int = ARITY) -> list[dict[int, str]]:
    """Of each level the nodes known, from the leaves and the fetched nodes; the last one is the root."""
    out = []
    own = dict(leaves)
    for level, n in enumerate(sizes):
        own |= {p: h for (at, p), h in fetched.items() if at == level}
        out.append(own)
        if level + 1 < len(sizes):
            parents = {p // arity for p in own}
            own = {q: digest("".join(own[c] for c in range(q * arity, min(n, (q + 1) * arity)))) for q in parents}
    return out


def proof_of(place: int, held: list[dict[int, str]], sizes: list[int], arity: int = ARITY) -> list[tuple[list[str], list[str]]]:
    """Level by level, the siblings to the left and to the right of a leaf's path."""
    out = []
    for level, n in enumerate(sizes[:-1]):
        first = place // arity * arity
        before = [held[level][c] for c in range(first, place)]
        after = [held[level][c] for c in range(place + 1, min(n, first + arity))]
        out.append((before, after))
        place //= arity
    return out


def folded(leaf: str, proof: list[tuple[list[str], list[str]]]) -> str:
    """The root that a leaf and its siblings give."""
    for before, after in proof:
        leaf = digest("".join([*before, leaf, *after]))
    return leaf


def prove(
    leaves: DataFrame, nodes: DataFrame, columns: list[tuple[str, str]], expand: Callable, part: int = PART, arity: int = ARITY
) -> DataFrame:
    """Rows (tree, place and ``columns``, names with types) made by ``expand`` from the leaves' proofs.

    ``leaves``: tree, place, hash, n and what else ``expand`` reads.  ``expand(table, proofs, root)``
    gets a leaf partition, each row's proof and the tree's root, and gives lists of ``columns``.
    """
    parted = leaves.withColumn("part", F.floor(F.col("place") / F.lit(part)).cast("bigint"))
    parted = materialize(parted, "leaves")
    depth = lambda n: levels(n, arity)

    def lacks(table: pa.Table) -> pa.Table:
        tree, part_no, n = (table[c][0].as_py() for c in ("tree", "part", "n"))
        wanted = missing(table["place"].to_pylist(), depth(n), arity)
        # Partitions below a node's parent may all fetch it, but for its own.
        copies = [max(1, -(-(arity ** (level + 1)) // (part * FETCHERS))) for level, _ in wanted]
        m = len(wanted)
        return pa.table(
            {
                "tree": pa.array([tree] * m, pa.int64()),
                "part": pa.array([part_no] * m, pa.int64()),
                "level": pa.array([level for level, _ in wanted], pa.int32()),
                "place": pa.array([p for _, p in wanted], pa.int64()),
                "copy": pa.array([part_no % c for c in copies], pa.int64()),
            }
        )

    wanted = parted.select("tree", "part", "place", "n").groupBy("tree", "part").applyInArrow(lacks, "tree bigint, part bigint, level int, place bigint, copy bigint")
    copies = F.greatest(F.lit(1).cast("bigint"), F.ceil(F.pow(F.lit(float(arity)), F.col("level") + 1) / F.lit(part * FETCHERS))).cast("bigint")
    copied = nodes.withColumn("most", F.ceil(F.col("n") / F.lit(part)).cast("bigint"))
    copied = copied.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.least(copies, F.col("most")) - 1))).drop("n", "most")
    fetched = wanted.join(copied, ["tree", "level", "place", "copy"]).select("tree", "part", "level", "place", "hash")

    def expanded(left: pa.Table, right: pa.Table) -> pa.Table:
        tree, n = left["tree"][0].as_py(), left["n"][0].as_py()
        sizes = depth(n)
        places = left["place"].to_pylist()
        got = dict(zip(zip(right["level"].to_pylist(), right["place"].to_pylist(), strict=True), right["hash"].to_pylist(), strict=True))
        held = derive(dict(zip(places, left["hash"].to_pylist(), strict=True)), got, sizes, arity)
        proofs = (proof_of(p, held, sizes, arity) for p in places)
        out = expand(left, proofs, held[-1][0])
        return pa.table(
            [pa.array([tree] * len(places), pa.int64()), left["place"].combine_chunks(), *(pa.array(c, pa.string()) for c in out)],
            names=["tree", "place", *(c for c, _ in columns)],
        )

    schema = ", ".join(["tree bigint", "place bigint", *(f"{c} {kind}" for c, kind in columns)])
    return parted.groupBy("tree", "part").cogroup(fetched.groupBy("tree", "part")).applyInArrow(expanded, schema)


def audit(docs: DataFrame, arity: int = ARITY, wide: int = WIDE, part: int = PART) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row.

    ``leaf``: SHA-256 of doc_id, source, lang, n_chars and text; ``subroot``: root of its language's
    tree, in which leaves go by doc_id (null first; rows of one doc_id by their leaves); ``root``:
    of the tree of subroots, by language (null first).  ``proof_sha256``: of the siblings on the way
    up to the root.  ``folded_root`` is what leaf and siblings give, after rows whose doc_id has a
    CRC-32 divisible by 7 had 1 added to n_chars, null staying null; ``verified``: it is the root.
    Rows that repeat are leaves of their own.  Other columns are not read.
    """
    text = lambda c: F.col(c).cast("string")
    doc_id, n_chars = F.col("doc_id").cast("bigint"), F.col("n_chars").cast("bigint")
    leaf = lambda n: leaf_of(doc_id, text("source"), text("lang"), n, text("text"))
    touched = (F.crc32(doc_id.cast("string").cast("binary")) % 7 == 0) & n_chars.isNotNull()
    # One more than the largest number has no 64 bits, so the sum is a decimal.
    more = n_chars.cast("decimal(20, 0)") + 1
    rows = docs.select(doc_id.alias("doc_id"), text("lang").alias("lang"), leaf(n_chars).alias("hash"), F.when(touched, leaf(more)).alias("tampered"))
    rows = numbered(rows, "lang", ["doc_id", "hash"], "rows")
    langs = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).withColumn("all", F.lit(0))
    langs = numbered(langs, "all", ["lang"], "langs").select(F.col("lang").alias("of"), F.col("place").alias("tree"), "n")
    langs = materialize(langs, "trees")
    leaves = materialize(rows.join(langs, F.col("lang").eqNullSafe(F.col("of"))).drop("of", "lang"), "placed")

    nodes = build(leaves, arity, wide)
    heads = nodes.groupBy("tree").agg(F.max_by("hash", "level").alias("subroot"))
    tops = heads.select(F.lit(TOP).cast("bigint").alias("tree"), F.col("tree").alias("place"), F.col("subroot").alias("hash"))
    tops = materialize(tops, "tops")
    tops = tops.withColumn("n", F.lit(tops.count()).cast("bigint"))
    flat = lambda proof: "".join(h for before, after in proof for h in (*before, *after))

    def way(table, proofs, root):
        proofs = list(proofs)
        sides = ["|".join(",".join(b) + ":" + ",".join(a) for b, a in p) for p in proofs]
        return [root] * len(proofs), sides

    top = prove(tops, build(tops, arity, wide), [("root", "string"), ("way", "string")], way, part, arity)
    top = materialize(top.select(F.col("place").alias("tree"), "root", "way"), "top")

    def tried(table, proofs, subroot):
        up = [(b.split(",") if b else [], a.split(",") if a else []) for b, a in (x.split(":") for x in table["way"][0].as_py().split("|") if x)]
        said, seen = [], []
        for proof, hashed, tampered in zip(proofs, table["hash"].to_pylist(), table["tampered"].to_pylist(), strict=True):
            proof = [*proof, *up]
            said.append(digest(flat(proof)))
            seen.append(folded(tampered or hashed, proof))
        n = len(said)
        return table["doc_id"].cast(pa.string()).to_pylist(), table["hash"].to_pylist(), [subroot] * n, [table["root"][0].as_py()] * n, said, seen

    columns = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root"]
    out = prove(leaves.join(top, "tree"), nodes, [(c, "string") for c in columns], tried, part, arity)
    return out.select(F.col("doc_id").cast("bigint"), *columns[1:], (F.col("folded_root") == F.col("root")).alias("verified"))
