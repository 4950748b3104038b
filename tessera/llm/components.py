"""Connected components by alternating large-star and small-star steps, each cut by a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_keys, materialize


def _step(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """Hang neighbours on the smallest one: the larger neighbours (large) or the smaller ones and the node."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
    joined = join_keys(both, least, ["a"], F.xxhash64("b"), total)
    if large:
        out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b")


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a, b), any integers -> (node, component): the smallest node reachable; nodes without edges are absent.

    Nulls and self-loops link nothing; repeated and reversed edges count once; no edges give no rows. A node's smallest
    neighbour is found by an aggregation that starts before the shuffle, and the edges of a node with a large share of
    them meet it in several tasks. The number of steps grows with the logarithm of the longest chain.
    """
    now = materialize(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).dropna().filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), narrow=True)
    while (total := _open(now)) is not None:
        now = materialize(_step(_step(now, True, 2 * total), False, 2 * total).distinct(), narrow=True)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _open(edges: DataFrame) -> int | None:
    """The number of edges, or None if every node hangs on one other, which hangs on none."""
    both = edges.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = both.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    r = nodes.agg(F.sum("up"), F.max((F.col("up") > 1) | ((F.col("up") == 1) & (F.col("down") == 1)))).first()
    return int(r[0]) if r[1] else None
