"""Connected components of an edge table by alternating large-star and small-star rounds (all steps are joins and aggregates).

Nodes with more than max(HOT, edges / SHARE) edges meet their neighbours by broadcast: there are at most 2 * SHARE of them
(or few edges at all), so the centre of a large star doesn't gather its neighbours in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

MAX_ROUNDS = 60
HOT, SHARE = 1000, 1000


def _star(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """One star step. edges: distinct (a, b) with a > b."""
    if large:
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("degree"))
    least = materialize(least, "star")
    hot = F.col("degree") > max(HOT, total // SHARE)
    few = F.broadcast(least.filter(hot).select("u", "m"))
    joined = near.join(few, "u").unionByName(near.join(few.select("u"), "u", "left_anti").join(least.filter(~hot).select("u", "m"), "u"))
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """(node, component) of every node with an edge; the component is its smallest node."""
    now = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), name)
    total = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    for _ in range(MAX_ROUNDS):
        if not total[0]:
            break
        now = materialize(_star(materialize(_star(now, True, total[0]), name), False, total[0]), name)
        new = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == total:
            break
        total = new
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
