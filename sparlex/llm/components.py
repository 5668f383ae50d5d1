"""Connected components: runs of edges become stars in their tasks, alternating large-star and small-star steps join these.

A task turns every PART edges that it reads into stars about their least nodes, which connect the same nodes with
no more edges; the tasks of the second pass follow the number of edges, so that up to PART edges are done by it. What
more there is goes through the steps. Edges are pairs (a, b) with a > b. A step reads each node's least neighbour
from a small written table, so that both sides of the join are plain exchanges and a node with very many edges is
split by adaptive execution; all else is partial aggregation. Nothing is collected.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, saved

PART = 1 << 20  # edges of one union in memory: 16 MB


def stars(edges: DataFrame, part: int = PART) -> DataFrame:
    """Edges (a, b) with a > b that connect what edges (a, b) connect, of every part edges that a task reads."""

    def union(held):
        a, b = (np.concatenate(x) for x in zip(*held))
        nodes, at = np.unique(np.r_[a, b], return_inverse=True)
        root = local_stars(len(nodes), at[: len(a)], at[len(a) :])
        far = np.flatnonzero(root != np.arange(len(nodes)))
        return nodes[far], nodes[root[far]]

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, part):
                one = batch.slice(at, part)
                if n + one.num_rows > part:
                    yield union(held)
                    held, n = [], 0
                held.append((one.column(0).to_numpy(), one.column(1).to_numpy()))
                n += one.num_rows
        if held:
            yield union(held)

    return map_arrow(edges.select("a", "b"), run, "a long, b long")


def components(edges: DataFrame, part: int = PART) -> DataFrame:
    """node, component (its least node) of every node of edges (a, b: long); others are their own."""
    e = saved(stars(edges.where("a is not null and b is not null and a <> b"), part), "edges")
    n = e.count()
    e = saved(stars(e.coalesce(max(1, -(-n // part))), part), "stars")

    def state(x):
        return tuple(x.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())

    def least(x):
        return saved(x.groupBy("a").agg(F.min("b").alias("m")), "least").withColumnRenamed("a", "node")

    now = state(e) if n > part else (0, None)
    while now[0]:
        m = least(e)
        e = e.join(m, e.b == m.node, "left").select("a", F.coalesce("m", "b").alias("b")).distinct()
        e = saved(e, "large")
        m = least(e)
        both = e.join(m, e.a == m.node).select("a", "b", "m")
        e = saved(both.select(F.inline(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))))).where("a <> b").distinct(), "small")
        before, now = now, state(e)
        if before == now:
            break
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def local_stars(n: int, a, b):
    """Labels 0..n-1 of the least index reachable over pairs (a, b) of one task."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new
