"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .skew import salted_join
from .work import Work


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least vertex of each vertex's component, for edges a - b among 0 .. n - 1."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _star(edges: DataFrame, large: bool, small: bool, work: Work) -> DataFrame:
    """One star step: hang the larger (or the smaller and equal) neighbours of each vertex on the least one."""
    if large:
        sided = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        sided = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = sided.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).withColumn("m", F.least("u", "m"))
    if small:
        met = sided.join(F.broadcast(least.drop("n")), "u")
    else:
        least = work.table(least, "least")
        met = salted_join(sided, least.drop("n"), ["u"], ["v"], counts=least)
    if large:
        return met.where("v > u and m <> v").select(F.col("m").alias("a"), F.col("v").alias("b"))
    # drops the repeats of the large star before it too
    return met.where("m <> v").select(F.col("m").alias("a"), F.col("v").alias("b")).union(least.where("m <> u").select(F.col("m").alias("a"), F.col("u").alias("b"))).distinct()


def _is_forest(edges: DataFrame) -> bool:
    """True if every vertex either is a centre or hangs on exactly one."""
    one = F.lit(1)
    ends = edges.select(F.col("a").alias("id"), one.alias("up"), F.lit(0).alias("down")).union(edges.select(F.col("b").alias("id"), F.lit(0).alias("up"), one.alias("down")))
    return ends.groupBy("id").agg(F.max("up").alias("up"), F.sum("down").alias("down")).where("down > 1 or (up = 1 and down > 0)").isEmpty()


def components(edges: DataFrame, work: Work, broadcast_edges: int = 500_000) -> DataFrame:
    """(id, component): the least id reachable, for every id that has an edge to another id.

    ``edges`` has columns a and b; null ends and loops are ignored. Each round
    is written to the shared folder; rounds grow with the logarithm of the
    longest path. While there are at most ``broadcast_edges`` edges, the least
    neighbours of their vertices, two a row at most, are broadcast; beyond
    that a join finds them, in which a vertex that many hang on is salted
    (``salted_join``), so its edges meet in no single task.
    """
    now = work.table(edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    while not _is_forest(now):
        small = now.count() <= broadcast_edges
        large = _star(now, True, small, work)
        if not small:
            large = work.table(large, "large")
        new = work.table(_star(large, False, small, work), "stars")
        work.drop(now, large)
        now = new
    return now.select(F.col("b").alias("id"), F.col("a").alias("component")).union(now.select(F.col("a").alias("id"), F.col("a").alias("component"))).distinct()
