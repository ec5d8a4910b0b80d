"""Connected components of links between numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlake.scale import cut_lineage


def connected_components(links: DataFrame) -> DataFrame:
    """``(id, component)``: the lowest id reachable over ``links (src, dst)``.

    Alternating large-star and small-star steps until nothing changes; each
    step is a partial minimum and an equi-join that adaptive execution splits
    where a node has many links. One checkpoint a step. Ids without a link, and
    links with a null end, are left out.
    """
    high, low = F.greatest("src", "dst"), F.least("src", "dst")
    whole = links.where(F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("src") != F.col("dst")))
    state, now = None, cut_lineage(whole.select(high.alias("high"), low.alias("low")).distinct())
    while True:
        turned = now.select(F.col("low").alias("high"), F.col("high").alias("low"))
        both = now.unionByName(turned)
        lowest = both.groupBy("high").agg(F.min("low").alias("m")).select("high", F.least("high", "m").alias("m"))
        # Large star: higher neighbours of a node link to its lowest neighbour, or to it.
        large = (
            both.where(F.col("low") > F.col("high")).join(lowest, "high")
            .select(F.col("low").alias("high"), F.col("m").alias("low")).distinct()
        )
        # Small star: lower neighbours of a node, and it, link to the lowest of them.
        least = large.groupBy("high").agg(F.min("low").alias("m"))
        small = (
            large.join(least, "high")
            .select(F.explode(F.array("low", "high")).alias("high"), F.col("m").alias("low"))
            .where(F.col("high") != F.col("low"))
            .distinct()
        )
        now = cut_lineage(small)
        digest = F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))
        then, state = state, tuple(now.agg(F.count("*"), digest).first())
        if then == state:
            return now.select(F.col("high").alias("id"), F.col("low").alias("component"))
