"""Connected components of a distributed edge list, by alternating large and small stars.

Each round hangs the larger neighbours of every node, and then the node and its smaller
neighbours, under the least neighbour. Rounds end when all edges point at the least
node of their component. A round is two joins on node numbers; every step is written
to the scratch folder, so lineage doesn't grow with the rounds, and joins read plain
tables, whose hot partitions Spark can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str = "star") -> DataFrame:
    """(node, label) of every node that has an edge, from edges (a, b); label is the least node reachable."""
    now = scratch.save(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), f"{name}-0")
    turn = 0
    while True:
        turn += 1
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.save(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{name}-{turn}-a")
        large = scratch.save(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), f"{name}-{turn}-b")
        least = scratch.save(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}-{turn}-c")
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        small = scratch.save(small.select("e.*").filter("u > v").distinct(), f"{name}-{turn}")
        # Done when no edge's lower end has an edge further down, and each node has one edge.
        open_ends = small.join(small.select(F.col("u").alias("v")), "v", "left_semi")
        done = open_ends.isEmpty() and small.groupBy("u").count().filter("count > 1").isEmpty()
        scratch.drop(f"{name}-{turn - 1}", f"{name}-{turn}-a", f"{name}-{turn}-b", f"{name}-{turn}-c")
        now = small
        if done:
            roots = now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
            return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)
