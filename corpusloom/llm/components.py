"""Connected components of an edge table, by alternating large-star and small-star steps.

Each task first contracts its own edges to a spanning forest, so that dense
groups reach the shuffle as stars.  The steps use minima and joins only: no
neighbour list is ever collected.  Every step's edges are written to the shared
folder, which cuts lineage and survives lost executors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_join, materialize, release


class Forest:
    """Union-find over integer ids; the root of a set is its least id."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        top = parent.setdefault(x, x)
        while parent[top] != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
        return a != b

    def stars(self) -> tuple[np.ndarray, np.ndarray]:
        nodes = list(self.parent)
        roots = np.fromiter((self.root(x) for x in nodes), np.int64, len(nodes))
        nodes = np.array(nodes, dtype=np.int64)
        own = nodes != roots
        return nodes[own], roots[own]


#: Edges that a task holds before it hands on what it has contracted.
HELD = 1_000_000
#: Nodes up to which a table of minima is broadcast (16 bytes each).
BROADCAST_NODES = 500_000


def edge_batch(a, b) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _contract(batches):
    forest = Forest()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if a != b:
                forest.join(a, b)
        if len(forest.parent) > HELD:
            yield edge_batch(*forest.stars())
            forest = Forest()
    yield edge_batch(*forest.stars())


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a long, b long) to (node, root): root is the least id of a node's component; lone nodes have no row."""
    held = materialize(edges.select("a", "b").where("a <> b").mapInArrow(_contract, "a long, b long").distinct(), "cc")
    seen = None
    while True:
        now = tuple(held.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())
        if now == seen or now[0] == 0:
            return held.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = now
        # the minima are written before they are joined: a node with many neighbours is then split or broadcast, not gathered
        # large star: each larger neighbour of u points to the least of u and its neighbours
        both = held.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(held.select(F.col("b").alias("u"), F.col("a").alias("v")))
        nearest = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc")
        large = bounded_join(both, nearest, "u", BROADCAST_NODES).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large, "cc")
        # small star: each smaller neighbour of u, and u, point to the least of them
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "cc")
        small = bounded_join(large, least, "u", BROADCAST_NODES)
        small = small.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        before, held = held, materialize(small.where("a <> b").distinct(), "cc")
        release(before, nearest, large, least)
