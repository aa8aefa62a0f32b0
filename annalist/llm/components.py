"""Connected components of an edge table: of a checked size in one task, beyond it by alternating large and small stars."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import forget, stored

#: Edges, once reduced to forests, that one task joins: about 200 MB of a worker's memory.
TASK_EDGES = 2_000_000


def _forests(batches):
    """A spanning forest of each batch of edges (a, b): stars whose middles are the smallest nodes."""
    for batch in batches:
        parent: dict[int, int] = {}

        def find(x):
            top = x
            while (up := parent.get(top, top)) != top:
                top = up
            while (up := parent.get(x, x)) != top:
                parent[x] = top
                x = up
            return top

        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = find(a), find(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
        nodes = list(parent)
        yield pa.record_batch({"a": pa.array(nodes, pa.int64()), "b": pa.array([find(x) for x in nodes], pa.int64())})


def _joined(batches):
    """(node, root) of all edges of the batches: roots hook onto smaller neighbours, then paths are cut short."""
    held = [tuple(c.to_numpy(zero_copy_only=False) for c in b.columns) for b in batches]
    if not held:
        return
    a, b = (np.concatenate(c) for c in zip(*held, strict=True))
    held.clear()
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while len(np.flatnonzero((up := root[root]) != root)):
            root = up
        a, b = root[a], root[b]
        a, b = a[apart := a != b], b[apart]
    low = np.flatnonzero(root != np.arange(len(nodes)))
    for i in range(0, len(low), 100_000):
        part = low[i : i + 100_000]
        yield pa.record_batch({"node": pa.array(nodes[part], pa.int64()), "root": pa.array(nodes[root[part]], pa.int64())})


def components(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` (a, b: long) is connected with; roots are left out.

    Batches of edges are reduced to forests first.  What then has at most ``task_edges`` edges is joined in one
    task: the rounds below cost the driver several jobs each, however few the edges.  Every step of a round is a
    pre-aggregated minimum and an equi-join on it, so a node with very many neighbours is split by AQE; nothing
    is collected.
    """
    now = stored(edges.where("a <> b").mapInArrow(_forests, "a long, b long").where("a <> b"), "edges", 100_000)
    if now.count() <= task_edges:
        found = stored(now.repartition(1).mapInArrow(_joined, "node long, root long"), "roots", 100_000)
        forget(now)
        return found
    while True:
        # done when every node has one smaller neighbour, which is a root
        low = now.groupBy("a").agg(F.min("b").alias("low"), F.max("b").alias("b"))
        if low.where("low < b").isEmpty() and low.join(now.select(F.col("b").alias("a")), "a", "left_semi").isEmpty():
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).distinct()
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e")).select("e.a", "e.b")
        old, now = now, stored(small.where("a <> b").distinct(), "edges")
        forget(old)
