"""Connected components of a graph of links, by stars that grow and shrink in turn."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvia.llm.common import checkpoint


def components(links: DataFrame) -> DataFrame:
    """u, v (long, not null) -> node, component: the smallest node reachable, for each node that has a link.

    Each round sends every node's larger neighbours to its smallest one, then its smaller neighbours likewise; links become
    stars in a few rounds (logarithmic in the length of a chain). Each half of a round ends in a checkpoint, so that its plan stays small; nothing is collected but a count and a sum.
    """

    def both(e: DataFrame) -> DataFrame:
        return e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))

    def sign(e: DataFrame):
        r = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        return r["n"], r["s"]

    edges = checkpoint(links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    last = sign(edges)
    while True:
        near = both(edges)
        least = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = checkpoint(near.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        edges = checkpoint(small)
        now = sign(edges)
        if now == last:
            break
        last = now
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return found.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
