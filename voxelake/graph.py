"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import staged


def roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest member of the component of each of ``n`` nodes, for links of one block of data, by
    hooking and pointer jumping."""
    root = np.arange(n)
    while len(left):
        a, b = root[left], root[right]
        apart = a != b
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(jumped := root[root], root):
            root = jumped
    return root


def _sums(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _both(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select("v", "u")).toDF("u", "v")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node hands its larger neighbours to the smallest node it sees."""
    near = _both(edges)
    low = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
    return near.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node joins its smaller neighbours, and itself, to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("low"))
    linked = down.join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v")
    return linked.union(low.toDF("u", "v")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` for every node of ``edges`` (columns ``u``, ``v``, any order): root is
    the smallest node of the component.  Loops and repeated edges are harmless; no edges, no rows.

    Each round is two joins whose grouped side holds one row per node, so a node with very
    many edges is a skewed join that adaptive execution splits.  Rounds are written to the
    shared folder, which cuts the lineage; the number of rounds grows with the logarithm of
    the longest chain.
    """
    now = staged(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = _sums(now)
    while seen[0]:
        now = staged(_small_star(_large_star(now)))
        sums = _sums(now)
        if sums == seen:
            break
        seen = sums
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
