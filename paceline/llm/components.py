"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.session import materialize

#: Edges a task contracts by itself; two numbers and a little more each.
EDGES_PER_TASK = 2_000_000


def local_roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node it is connected with) of every node that is not its own."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        # Both ends' roots hang below the smaller one; then paths are halved until flat.
        np.minimum.at(root, before[a], low)
        np.minimum.at(root, before[b], low)
        while (flat := root[root]).tobytes() != root.tobytes():
            root = flat
        if np.array_equal(root, before):
            break
    far = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[far], nodes[root[far]]


def _contract(edges: DataFrame, parts: int) -> DataFrame:
    """Edges replaced by stars around the smallest node of what each task sees."""

    def rows(batches: Iterator[pa.RecordBatch]):
        got = [(np.asarray(b.column("u")), np.asarray(b.column("v"))) for b in batches]
        if got:
            u, v = local_roots(*(np.concatenate(c) for c in zip(*got, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return edges.repartition(parts).mapInArrow(rows, "u bigint, v bigint")


def _stars(edges: DataFrame) -> DataFrame:
    """One round between tasks: larger neighbours to the smallest one, then the
    smaller ones and the node itself to the smallest one.  The smallest neighbour
    is a partial aggregate, so a node with many edges is no hot key there."""
    both = edges.union(edges.select("v", "u")).toDF("x", "y")
    low = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
    large = both.join(low, "x").filter("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).filter("x <> y")
    low = large.groupBy("x").agg(F.min("y").alias("m"))
    small = large.join(low, "x").select("y", "m").union(low.select("x", "m")).toDF("u", "v")
    return small.filter("u <> v").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", edges_per_task: int = EDGES_PER_TASK) -> DataFrame:
    """(node, component) of every node with an edge to another; the component is its smallest node.

    Each round, tasks contract their share of the edges into stars, which leaves
    nothing to do once a single share holds all; else a round of joins links the
    stars of different tasks.  Edges never grow, rounds grow with the logarithm
    of the nodes, and each round is written, so lineage stays short.
    """
    given = edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
    now = materialize(given.filter("u <> v"), "edges")
    n, last = now.count(), None
    while True:
        parts = max(1, -(-n // edges_per_task))
        contracted = _contract(now, parts)
        now = materialize(contracted if parts == 1 else _stars(contracted), "stars")
        if parts == 1:
            break
        n, *marks = now.agg(
            F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        # Stars that a round leaves as they are, are whole components.
        if [n, *marks] == last:
            break
        last = [n, *marks]
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(now.select("v", "v").distinct())
