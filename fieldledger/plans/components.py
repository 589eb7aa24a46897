"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldledger.plans.fragments import lookup
from fieldledger.session import stored


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component``, the smallest node that can be reached, of every node that has a link.

    ``links`` has two columns ``a`` and ``b`` of one type, in any direction, repeats allowed; a link of a node with itself
    makes it a node. Two steps alternate until nothing changes: every node hangs its larger neighbours on its smallest
    one, then its smaller ones; the number of turns grows with the logarithm of the longest chain, not with its
    length. A node with very many links is aggregated in parts, and its join can be split.
    """
    links = links.select("a", "b")
    alone = links.where("a = b").select(F.col("a").alias("node"), F.col("b").alias("component"))
    now, before = stored(links.where("a <> b").distinct(), "links"), None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = lookup(both, least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = lookup(large, smallest, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = stored(small.unionByName(smallest.select("a", F.col("m").alias("b"))).distinct(), "links")
        mark = F.xxhash64("a", "b")
        after = now.agg(F.count(F.lit(1)), F.sum(mark.bitwiseAND(0xFFFFFFFF)), F.sum(F.shiftright(mark, 32))).first()
        if after == before:
            break
        before = after
    found = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = found.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).unionByName(alone)
    return found.groupBy("node").agg(F.min("component").alias("component"))
