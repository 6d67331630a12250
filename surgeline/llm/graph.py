"""Connected components over edges of any number, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surgeline.llm.shared import Scratch


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges (a, b): rows (node, root) for each node with an edge; root is the smallest node reachable.

    Every round hangs each node's larger neighbours, then its smaller ones, on
    the smallest neighbour. Rounds end when every node hangs on a root alone.
    Each round is a table in the shared folder; no group is ever gathered,
    as only minima are aggregated (with partial sums before the shuffle).
    Loops and repeated edges do no harm; null ends are ignored.
    """
    now = scratch.table(edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).distinct())
    while True:
        both = now.select(F.col("v").alias("u"), F.col("m").alias("w")).union(now.select("m", "v"))
        least = both.groupBy("u").agg(F.min("w").alias("x")).select("u", F.least("u", "x").alias("m"))
        large = both.where("w > u").join(least, "u").select(F.col("w").alias("v"), "m").distinct()
        down = large.groupBy("v").agg(F.min("m").alias("x"))
        small = large.join(down, "v").where("m <> x").select(F.col("m").alias("v"), F.col("x").alias("m")).union(down.select("v", "x"))
        after = scratch.table(small.distinct())
        scratch.drop(now)
        now = after
        n, nodes = now.agg(F.count("*"), F.count_distinct("v")).first()
        if n == nodes and not now.join(now.select(F.col("v").alias("m")), "m", "left_semi").limit(1).count():
            return now.select(F.col("v").alias("node"), F.col("m").alias("root")).union(now.select("m", "m").distinct())
