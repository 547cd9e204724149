"""Connected components of an edge table, in rounds of joins and groupings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, written


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``n`` nodes the smallest node that edges ``a``–``b`` reach."""
    root = np.arange(n)
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        on = low < high
        if not on.any():
            break
        a, b, low, high = a[on], b[on], low[on], high[on]
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
    return root


def connected_components(edges: DataFrame) -> DataFrame:
    """``id`` and ``component``, the smallest id that edges (a, b) reach, of every node that is not its component's smallest.

    Alternates two steps on edges that point to smaller ids. The first hangs a node's larger
    neighbours under its smallest one, the second its smaller neighbours; both keep the
    components. It ends when the edges stay as they are, which then are stars. Each round's edges
    are written to the shared folder, and deleted once the next are. A node's neighbours are only ever counted by minimum or
    joined, never gathered.
    """
    spark = edges.sparkSession
    now, path = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "edges")
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38)"))).first()
        if mark[0] == 0 or mark == seen:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component"))
        seen = mark
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large, between = written(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now, after = written(small.union(least.select("u", "m")).distinct(), "edges")
        discard(spark, path, between)
        path = after
