"""Connected components of a table of links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.plans.cut import discard, staged


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1_000_003)).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component): for each end of a link (u, v; of any type with an order) the smallest node that it reaches.

    Nodes without links, and links of a node to itself, give no row. Repeated links do no harm; links with a null end
    are ignored. Every round is a fixed number of shuffles over the links; neither links nor labels reach the driver,
    only a count and a checksum. A hub with very many links is pre-aggregated (min) before it is shuffled, and the joins
    are plain equi-joins of two shuffled tables, which adaptive execution splits where a key is hot.
    """
    edges = staged(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        first = staged(both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m")))
        large = staged(both.join(first, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        low = staged(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, edges = edges, staged(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        discard(old, first, large, low)
        before, state = state, _state(edges)
        if state == before:
            break
    out = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    labels = staged(out.unionByName(roots))
    discard(edges)
    return labels
