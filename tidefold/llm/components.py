"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is one minimum per node (combined before the shuffle, and written) and one join with it, which adaptive
execution can split where a node has very many edges; no neighbourhood is ever collected, every step's edges are
written to the shared folder, and those of the step before are removed. Edges of a node with itself, repeated ones
and both directions of one count once; an empty table has no components.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefold.llm.shared import forget, written


def _unsettled(edges: DataFrame) -> int:
    """Nodes with two edges to lesser nodes, or with edges to both sides; without any, every component is a star."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").count()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that has an edge (u, v); the component is its least node."""
    now = written(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while _unsettled(now):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "least")
        large = written(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct(), "edges")
        forget(now, least)
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u != v").distinct()
        now = written(small, "edges")
        forget(large, least)
    out = now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    out._tidefold_path = now._tidefold_path  # type: ignore[attr-defined]  # what forget() removes
    return out
