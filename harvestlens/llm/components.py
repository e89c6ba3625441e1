"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harvestlens.session import cut


def _both(links: DataFrame) -> DataFrame:
    return links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(links: DataFrame) -> DataFrame:
    """Connect every larger neighbour of a node to the smallest of the node and its neighbours."""
    both = _both(links)
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return (both.filter("b > a").join(least, "a").filter("b <> m")
            .select(F.col("m").alias("a"), F.col("b").alias("b")).distinct())


def _small_star(links: DataFrame) -> DataFrame:
    """Connect a node and its smaller neighbours to the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    own = least.select("m", F.col("a").alias("b"))
    rest = down.join(least, "a").filter("b <> m").select("m", "b")
    return own.union(rest).select(F.col("m").alias("a"), "b").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node of ``links`` (a, b).

    Alternates the two star steps until nothing changes; then every node is linked to the smallest
    of its component. Links are deduplicated in every step, no neighbour list is gathered, and each
    step is written to the shared folder.
    """
    links = cut(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    seen = None
    while True:
        state = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        links = cut(_small_star(_large_star(links)))
    return links.select(F.col("b").alias("node"), F.col("a").alias("component")).union(
        links.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
