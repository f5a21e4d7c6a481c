"""Connected components of a graph given as edges, by alternating star contractions (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provframe.llm.common import materialize


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step; edges and result run from the larger node to the smaller."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(least, "a")
    ends = F.explode(F.array("a", "b")).alias("a")
    return small.select(ends, F.col("m").alias("b")).where("a <> b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge list (a, b), root being the smallest node reachable.

    Each round is written to the shared folder, so lineage stays short. Work per round is linear in the edges; joins
    run on node ids, whose hot partitions adaptive execution splits. No edges give no rows.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    edges, mark = materialize(edges, "edges"), None
    while True:
        sums = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if not sums[0] or sums == mark:
            break
        mark, edges = sums, materialize(_stars(edges), "edges")
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
