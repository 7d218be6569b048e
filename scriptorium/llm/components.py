"""Connected components of a graph too large for one machine, by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import work_table


def _to_smallest(edges: DataFrame, both: bool) -> DataFrame:
    """Point a node's neighbours (its larger ones, or itself and its smaller ones) to the least of them and itself."""
    if both:
        edges = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("least"))
    joined = edges.join(least, "u")
    if both:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(least.select("u", F.col("least").alias("v")))
    return out.filter("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of an edge.

    ``edges`` has integer columns a and b. Large-star and small-star steps alternate until
    every node points to its component's smallest node; the number of rounds grows with the
    logarithm of the longest path. Each round is a written table. Loops give no row, no
    edges an empty table.
    """
    stars = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    stars = work_table(stars, "edges")
    while True:
        large = _to_smallest(stars, both=True).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        after = work_table(_to_smallest(work_table(large, "large-star"), both=False), "small-star")
        # Done once every node points to one smaller node that points nowhere.
        tangled = after.groupBy("u").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count()
        if not tangled and not after.join(after.select(F.col("u").alias("v")).distinct(), "v", "left_semi").limit(1).count():
            break
        stars = after
    roots = after.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return after.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
