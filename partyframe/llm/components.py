"""Connected components of an edge table (alternating large and small stars)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, component): every node of an edge with the smallest node reachable from it.

    Each round links all larger neighbours of a node, then all smaller ones,
    to its smallest neighbour, until nothing changes; rounds grow with the
    logarithm of the longest path.  A hub's neighbours are never gathered: its
    smallest neighbour is a partial aggregate, joined back to its edges (a
    join that Spark can split where one node has most of them).  Edges with a
    null end and loops are left out.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    now = checkpointed(edges.select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v"))
                       .filter(x.isNotNull() & y.isNotNull() & (x != y)).distinct())
    stamp = _stamp(now)
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m"))
        least = least.select("n", F.least("n", "m").alias("m"))
        large = (now.select(F.col("v").alias("n"), F.col("u").alias("far")).join(least, "n")
                 .select(F.col("far").alias("u"), F.col("m").alias("v")).filter("u != v").distinct())
        large = checkpointed(large)
        low = large.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m"))
        hop = large.select(F.col("u").alias("n"), "v").join(low, "n")
        now = checkpointed(hop.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
                           .unionByName(low.select(F.col("n").alias("u"), F.col("m").alias("v"))).distinct())
        before, stamp = stamp, _stamp(now)
        if stamp == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component")))


def _stamp(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return r["n"], r["s"]


def merge(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inside a task: labels (indexes of earlier nodes) after joining the pairs (a, b)."""
    while True:
        la, lb = labels[a], labels[b]
        apart = la != lb
        if not apart.any():
            return labels
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        low = np.minimum(la, lb)
        np.minimum.at(labels, la, low)
        np.minimum.at(labels, lb, low)
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels = up
