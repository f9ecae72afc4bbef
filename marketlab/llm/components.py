"""Connected components of an edge table, by alternating star contractions.

Each round rewrites the edges so that every node points to the least node it has seen: first towards
neighbours greater than itself (large star), then towards those that are smaller (small star).  Both are
a grouped minimum, combined before the shuffle, and a join that Spark may split where a node is hot.
Edges are written after each round, so neither lineage nor driver memory grows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlab.session import materialize


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links reduced to one edge (node, least node of its component) for every other node."""
    if not len(a):
        return a, b
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[:len(a)], at[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    rest = label != np.arange(len(nodes))
    return nodes[rest], nodes[label[rest]]


def _reduced(edges: DataFrame) -> DataFrame:
    def reduce(batches):
        for p in batches:
            a, b = forest(p["a"].to_numpy(), p["b"].to_numpy())
            yield pd.DataFrame({"a": a, "b": b})

    return edges.mapInPandas(reduce, "a long, b long")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("least"))
    least = least.select("a", F.least("a", "least").alias("least"))
    linked = both.join(least, "a")
    if large:
        out = linked.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:  # here a > b always: every smaller neighbour and the node itself go to the least one
        out = linked.select(F.col("b").alias("a"), F.col("least").alias("b")).unionAll(
            least.select("a", F.col("least").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges(a long, b long)``; component is its least node.

    Loops and repeated edges are allowed.  Nodes without an edge are not returned.
    """
    oriented = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = materialize(_reduced(oriented).distinct(), "edges")

    def mark(df):
        return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    before = mark(now)
    while before[0]:
        now = materialize(_star(_star(now, True), False), "edges")
        after = mark(now)
        if after == before:
            break
        before = after
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return roots.unionAll(roots.select(F.col("component").alias("node"), "component").distinct())
