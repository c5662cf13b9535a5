"""Connected components of a link table, on the cluster: no link or label comes to the driver.

Each round gives every vertex the neighbour (or itself) of least random priority and contracts the links along that
choice. Priorities are new in each round, so a constant share of the vertices goes in each, whatever the order of the
ids: long chains need about as many rounds as stars. The tables of a round are written to the shared folder, so a lost
executor never costs more than the round.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweave.llm.common import drop, written


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every vertex of links (a, b); the component is its smallest vertex.

    Repeated links, links in both directions and links of a vertex to itself change nothing; null ends are ignored.
    """
    edges = written(links.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels, round_no, steps = None, 0, []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = F.struct(F.xxhash64(F.lit(round_no), "b").alias("h"), F.col("b").alias("v"))
        own = F.struct(F.xxhash64(F.lit(round_no), "a").alias("h"), F.col("a").alias("v"))
        step = written(both.groupBy("a").agg(F.min(first).alias("best")).select(F.col("a").alias("node"), F.least(own, "best")["v"].alias("to")), "step")
        steps.append(step)
        if labels is None:
            labels = step.select("node", F.col("to").alias("root"))
        else:
            moved = step.select(F.col("node").alias("root"), "to")
            last, labels = labels, written(labels.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "labels")
            drop(last)
        left = step.select(F.col("node").alias("a"), F.col("to").alias("c"))
        right = step.select(F.col("node").alias("b"), F.col("to").alias("d"))
        before, edges = edges, written(edges.join(left, "a").join(right, "b").where("c <> d").select(F.least("c", "d").alias("a"), F.greatest("c", "d").alias("b")).distinct(), "edges")
        drop(before)
        round_no += 1
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    lowest = written(labels.groupBy("root").agg(F.min("node").alias("component")), "lowest")
    out = written(labels.join(lowest, "root").select("node", "component"), "components")
    drop(edges, labels, lowest, *steps)
    return out


def joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the links of one task, others that join the same vertices to components: each vertex to the smallest of its component, fewer than there are vertices."""
    if not len(a):
        return a, b
    vertices, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(vertices))
    while True:
        p, q = root[x], root[y]
        open_links = p != q
        if not open_links.any():
            break
        x, y, p, q = x[open_links], y[open_links], p[open_links], q[open_links]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    own = np.flatnonzero(root != np.arange(len(vertices)))
    return vertices[root[own]], vertices[own]
