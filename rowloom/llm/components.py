"""Connected components of links, by rounds of large and small stars over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import store


def components(links: DataFrame) -> DataFrame:
    """(node, component) for each node of (a, b): component is the least node that links lead to.

    Each round joins links with one row for each node; no node's links come together in one task.
    """
    links = store(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = store(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "links")
        last, state = state, tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if state == last:
            break
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
