"""Connected components by local contractions, for link tables of any size."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of edges(u, v), component being the smallest node reachable. u and v are of one type that has an order.

    In each round every node joins the neighbour (or itself) that comes first in a fresh pseudo-random order, and the
    graph is contracted; a constant share of the nodes goes each time, whatever the shape. A node's neighbours are only
    ever reduced to a minimum, before the shuffle too, so a node with very many of them is no hot group."""
    left = stored(edges.filter("u <> v").select("u", "v").union(edges.filter("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "graph-edges")
    nodes = left.select(F.col("u").alias("node")).distinct()
    at: DataFrame | None = None
    step = 0
    while not left.isEmpty():
        step += 1
        rank = lambda c: F.struct(F.xxhash64(F.lit(step), c), c.alias("n"))  # noqa: E731, B023
        to = stored(left.groupBy("u").agg(F.least(F.min(rank(F.col("v"))), F.min(rank(F.col("u"))))["n"].alias("p")), "graph-step")
        parents = to.select(F.col("u").alias("k"), "p")
        new = (
            left.join(parents.withColumnRenamed("p", "pu"), F.col("u") == F.col("k")).select("pu", "v")
            .join(parents.withColumnRenamed("p", "pv"), F.col("v") == F.col("k")).select(F.col("pu").alias("u"), F.col("pv").alias("v"))
            .filter("u <> v").distinct()
        )
        new = stored(new, "graph-edges")
        if at is None:
            at = stored(to.select(F.col("u").alias("node"), F.col("p").alias("root")), "graph-roots")
        else:
            was, at = at, stored(at.join(parents, F.col("root") == F.col("k"), "left").select("node", F.coalesce("p", "root").alias("root")), "graph-roots")
            drop_stored(was)
        drop_stored(to)
        drop_stored(left)
        left = new
    if at is None:
        return nodes.select("node", F.col("node").alias("component"))
    least = at.groupBy("root").agg(F.min("node").alias("component"))
    return at.join(least, "root").select("node", "component")


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of 0 .. n - 1 the smallest one that the pairs (i, j) connect it with."""
    root = np.arange(n)
    while len(i):
        a, b = root[i], root[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
    return root


def paths(n: int, i: np.ndarray, j: np.ndarray, group: np.ndarray) -> tuple[list[int], list[int]]:
    """Pairs that connect what the pairs (i, j) of 0 .. n - 1 connect: a path through each component, one group after the other, in
    order. No node has more than two of them, and a group that is connected has the same ones whatever it is seen with."""
    root = roots(n, np.asarray(i, np.int64), np.asarray(j, np.int64))
    order = np.lexsort((np.arange(n), np.asarray(group), root))
    next_to = root[order[:-1]] == root[order[1:]]
    return order[:-1][next_to].tolist(), order[1:][next_to].tolist()
