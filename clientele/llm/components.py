"""Connected components by alternating large and small stars.

A round replaces the neighbours of each node by links to the smallest of them. Minima are
pre-aggregated and joined back, so a node with a third of all links is never gathered in
one task. The links of a round are written to the shared folder. The number of rounds grows
with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def _large(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = saved(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least", small=True)
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(links: DataFrame) -> DataFrame:
    least = saved(links.groupBy("a").agg(F.min("b").alias("m")), "least", small=True)
    joined = links.join(least, "a")
    return joined.select("a", F.col("m").alias("b")).unionByName(
        joined.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")))


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) for every node of the links a-b that isn't
    its own root. Order within a link, repeated links and loops don't matter."""
    links = saved(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links", small=True)
    state = _state(links)
    while state[0]:
        links = saved(_large(links).where("a != b").distinct(), "links", small=True)
        links = saved(_small(links).where("a != b").distinct(), "links", small=True)
        if (now := _state(links)) == state:
            break
        state = now
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
