"""Connected components by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_materialized, materialize


def _stars(edges: DataFrame, both_ways: bool) -> DataFrame:
    """Join every node's neighbours with the smallest of them (the node itself included).

    The minima are written first: the join's partitions are then its own, and those of a node with
    very many neighbours can be split.
    """
    near = edges.select("u", "v")
    if both_ways:
        near = near.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return near.join(materialize(least, "edges-least"), "u")


def connected_components(edges: DataFrame) -> DataFrame:
    """``u, v`` (u linked with v) -> ``node, root`` for every node that has a link, root the smallest node.

    Nothing but edges moves: minima are pre-aggregated, each round is written to the shared folder
    and the rounds end when a round changes nothing, after about log(nodes) rounds. Loops and repeated
    edges are allowed; an empty table gives an empty table.
    """
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = materialize(edges, "edges")
    before = None
    while True:
        large = _stars(edges, both_ways=True).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        stars = _stars(large, both_ways=False)
        small = stars.select("v", "m").union(stars.select(F.col("u").alias("v"), "m")).where("v <> m").distinct()
        after = materialize(small.select(F.col("v").alias("u"), F.col("m").alias("v")), "edges")
        state = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_materialized(edges)
        edges = after
        if state == before:
            break
        before = state
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
