"""Connected components by alternating star steps, one landed table a step.

Links are kept as (u, v) with v < u. A large step hands every larger neighbour of a node the
node's smallest neighbour; a small step hands every smaller one, and the node itself, the
same. Both keep what is connected and pull links towards the smallest node, until each node
has one link, to the smallest node of its component. A node's smallest neighbour is a
map-side minimum, and a node with very many links is dealt over tasks (`spread_join`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibspark.session import land
from bibspark.skew import spread_join


def _with_least(links: DataFrame) -> DataFrame:
    """(u, v, least): the links of each node with the smallest of its neighbours."""
    least = links.groupBy("u").agg(F.min("v").alias("least"), F.count(F.lit(1)).alias("n"))
    return spread_join(links, least, "u", rows="n").select("u", "v", "least")


def _large_step(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    far = _with_least(both).where("v > u")
    return far.select(F.col("v").alias("u"), F.least("least", "u").alias("v"))


def _small_step(links: DataFrame) -> DataFrame:
    near = _with_least(links)
    pair = F.when(F.col("v") == F.col("least"), F.struct("u", F.col("least").alias("v"))).otherwise(
        F.struct(F.col("v").alias("u"), F.col("least").alias("v"))
    )
    return near.select(pair.alias("x")).select("x.u", "x.v")


def _is_done(links: DataFrame) -> bool:
    """Whether every node has one link and none links to a node that has one itself."""
    if not links.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return False
    onward = links.select(F.col("v").alias("u")).distinct()
    return links.join(onward, "u", "left_semi").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that `edges` (a, b) link to another: the smallest node they reach.

    Null ends and links of a node to itself are dropped; repeated links count once. Nothing
    but the answer whether another step is needed reaches the driver.
    """
    pairs = edges.na.drop(subset=["a", "b"]).where("a <> b")
    links = land(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    while not _is_done(links):
        links = land(_large_step(links).distinct(), "links")
        links = land(_small_step(links).distinct(), "links")
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
