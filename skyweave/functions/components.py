"""Connected components of a link table by alternating large and small stars."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import stored

#: So many links at most are put together by one task; more go in rounds.
FEW_LINKS = 100_000


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least node, of n, that links a-b reach from each node."""
    up = np.arange(n)
    while True:
        low = np.minimum(up[a], up[b])
        new = up.copy()
        np.minimum.at(new, up[a], low)
        np.minimum.at(new, up[b], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == up).all():
            return up
        up = new


def _few(links: pd.DataFrame) -> pd.DataFrame:
    nodes, at = np.unique(links[["a", "b"]].to_numpy(), return_inverse=True)
    at = at.reshape(-1, 2)
    return pd.DataFrame({"node": nodes, "component": nodes[roots(at[:, 0], at[:, 1], len(nodes))]})


def _to_least(edges: DataFrame, small: bool) -> DataFrame:
    """Each node's neighbours (the larger ones, or else the smaller ones and itself) now point to its least neighbour.

    The least is aggregated before the join, so a node with very many links is never gathered in one task.
    """
    both = edges if small else edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("least")).withColumn("least", F.least("a", "least"))
    moved = both.join(least.hint("merge"), "a")
    if small:
        out = moved.select(F.col("b").alias("a"), F.col("least").alias("b")).union(least.select("a", F.col("least").alias("b")))
    else:
        out = moved.filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return out.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(a, b) links of longs to (node, component): the least node that links reach. Nodes without links are absent."""
    edges = stored(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    if edges.count() <= FEW_LINKS:
        return edges.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(_few, "node long, component long")
    before = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
        edges = stored(_to_least(_to_least(edges, small=False), small=True), "links")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
