"""Connected components by alternating large-star and small-star steps.

Each step replaces the edges by edges to the smallest known neighbour and
keeps the components; the edges end as stars around the smallest node of each
component. Minima combine map-side. The steps go on until the edges stay as
they are, however long the longest chain is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linegrain.scale import ordered_index
from linegrain.session import cut

def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node around it."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return (
        both.join(least, ["u"], "inner")
        .where(F.col("v") > F.col("u"))
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, ["u"], "inner").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _signature(edges: DataFrame) -> tuple:
    """One row that changes when the edges change."""
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("v").cast("decimal(38,0)")))
    return tuple(row.first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that has an edge; ``edges`` has integer columns u and v."""
    current = cut(edges.select("u", "v").where("u <> v").distinct())
    seen = None
    now = _signature(current)
    while now != seen:
        current = cut(_small_star(_large_star(current)))
        seen, now = now, _signature(current)
    stars = current.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = stars.select(F.col("root").alias("node"), "root").distinct()
    return stars.unionByName(roots)


def clusters(types: DataFrame, pairs: DataFrame) -> DataFrame:
    """``CL_001`` … by size and smallest sequence number; sequences without a pair stand alone."""
    found = components(pairs.select(F.col("seq_no_a").alias("u"), F.col("seq_no_b").alias("v")))
    member = types.join(found, types["seq_no"] == found["node"], "left").withColumn(
        "root", F.coalesce("root", "seq_no")
    )
    sizes = member.groupBy("root").agg(F.count(F.lit(1)).alias("cluster_size"))
    ranked = ordered_index(sizes.withColumn("_s", -F.col("cluster_size")), ["_s", "root"], "cluster_no")
    named = ranked.select(
        "root", "cluster_size", F.format_string("CL_%03d", "cluster_no").alias("cluster_id")
    )
    return member.drop("node").join(named, ["root"], "inner").drop("root")
