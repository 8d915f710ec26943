"""Connected components by rounds of large-star and small-star over stored edge tables, finished by union-find."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import map_batches, stash

ROUNDS = 40
#: Edges that one task takes in at most (some hundred bytes each).
LAST_EDGES = 1_000_000


def _forest(batches):
    """A partition's edges as stars about the smallest node of each local component: fewer edges, same components."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
    nodes = np.fromiter(parent, dtype=np.int64, count=len(parent))
    roots = np.fromiter((root(x) for x in list(parent)), dtype=np.int64, count=len(parent))
    differ = nodes != roots
    for k in range(0, int(differ.sum()), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[differ][k : k + 100_000]), pa.array(roots[differ][k : k + 100_000])], names=["u", "v"])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours are linked to the smallest of them and the node."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component) of every node that has a link; component: the smallest `first` of the nodes reachable.

    links: (a, b) longs; nodes: (node, first). Edges are first contracted within partitions (a partition's nodes are
    held in memory: at most two for each of its edges), then in rounds, each a stored table that outlives executors,
    until they settle or at most LAST_EDGES are left, which one task joins up.
    """
    edges = stash(map_batches(links.select(F.col("a").cast("long").alias("u"), F.col("b").cast("long").alias("v")), _forest, "u long, v long"), "edges")
    before = None
    for _ in range(ROUNDS):
        if edges.count() <= LAST_EDGES:
            edges = stash(map_batches(edges.coalesce(1), _forest, "u long, v long"), "edges")
            break
        edges = stash(_star(_star(edges, True), False), "edges")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components do not settle in {ROUNDS} rounds")
    grouped = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    grouped = grouped.unionByName(grouped.select(F.col("root").alias("node"), "root").distinct())
    named = grouped.join(nodes, "node").groupBy("root").agg(F.min("first").alias("component"))
    return grouped.join(named, "root").select("node", "component")
