"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _star(e: DataFrame, large: bool) -> DataFrame:
    """large: every neighbour above u joins u's least neighbour; small: every neighbour below u does.

    The least neighbour meets u's edges in a join, so a hub's edges are never one row."""
    if large:
        e = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = e.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    out = e.join(near, "a")
    if large:
        out = out.where("b > a").select("b", "m")
    else:
        out = out.select("b", "m").unionByName(near.select(F.col("a").alias("b"), "m"))
    return out.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the least node that each node of ``edges`` (a, b) is connected to.

    Self loops and repeated edges have no effect; an empty table gives an empty one.
    Each round halves paths, so rounds grow with the logarithm of the longest path.
    """
    e = cut(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if tuple(now) == seen or now[0] == 0:
            break
        seen = tuple(now)
        e = cut(_star(_star(e, True), False))
    lone = e.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(lone)
