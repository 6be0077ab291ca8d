"""Connected components of an edge table, on DataFrames only: alternating large and small stars.

Nodes are longs. Edges are replaced by edges to the smallest neighbour until every node points to the smallest node of
its component. No neighbourhood is gathered anywhere: minima are partial aggregates, and joins
deal the edges of hot nodes over many tasks. Only the last round's tables stay.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, join_hot, stored


def find(root: np.ndarray, x: np.ndarray) -> np.ndarray:
    r = root[x]
    while True:
        up = root[r]
        if np.array_equal(up, r):
            root[x] = r
            return r
        r = up


def join(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Hooks the larger root under the smaller one until the pairs agree."""
    while True:
        ra, rb = find(root, a), find(root, b)
        differ = ra != rb
        if not differ.any():
            return
        a, b = a[differ], b[differ]
        low, high = np.minimum(ra[differ], rb[differ]), np.maximum(ra[differ], rb[differ])
        np.minimum.at(root, high, low)


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """edges: columns u, v; any direction, repeats and loops allowed, nulls ignored. Gives node, component for each node that has an edge to another."""
    now = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    for _ in range(rounds):
        # Large star: larger neighbours move to the smallest of the neighbours and the node itself.
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stored(both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n"), "edges-low")
        large = join_hot(both.where("v > u"), low, "u", "n").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large, "edges-large")
        # Small star: smaller neighbours and the node itself move to the smallest of them.
        dropped(low)
        low = stored(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "edges-low")
        small = join_hot(large, low, "u", "n").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v")))
        last, now = now, stored(small.where("u <> v").distinct(), "edges")
        for table in (last, large, low):
            dropped(table)
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = state
    raise RuntimeError("components did not settle")
