"""Connected components, in a task and over a cluster."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clicktrail.sources.shared import stash


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index in the component of each of ``n`` nodes, given the links ``a[i]-b[i]``.

    Hooks the larger root onto the smaller and halves paths until nothing changes; every
    round works on whole arrays.
    """
    root = np.arange(n)
    a, b = np.asarray(a), np.asarray(b)
    while len(a):
        ra, rb = root[a], root[b]
        differ = ra != rb
        if not differ.any():
            break
        a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while not np.array_equal(nxt := root[root], root):
            root = nxt
    return root


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Component of every linked node but the component's own smallest.

    ``links`` has longs ``u`` and ``v``; rows with null or equal ends are no links. Returns
    (``node``, ``component``), ``component`` the smallest node reachable. Alternates large
    and small stars: each round is two grouped minima and two joins, no node's neighbours are
    gathered in a task, and the minima are tables of their own, so that adaptive execution
    can split the rows of a hot node. Rounds grow with the logarithm of a component's size.
    """
    edges = stash(
        links.where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    for _ in range(max_rounds):
        if _is_forest_of_stars(edges):
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        edges = stash(_small_star(stash(_large_star(edges), "large-star")), "small-star")
    raise RuntimeError(f"no fixed point in {max_rounds} rounds")


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Every node hangs on one node that hangs on none."""
    per_node = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
    if per_node.where("n > 1").limit(1).count():
        return False
    centres = edges.select(F.col("v").alias("u")).distinct()
    return centres.join(edges, "u", "left_semi").limit(1).count() == 0


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of a node move to the smallest of it and its neighbours."""
    ways = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = stash(ways.groupBy("u").agg(F.min("v").alias("m"))
                  .select("u", F.least("u", "m").alias("m")), "least")
    moved = ways.where("v > u").join(least, "u")
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the smallest of them."""
    least = stash(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()
