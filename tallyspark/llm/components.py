"""Connected components of a graph held in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import stage


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node that each node of ``edges`` (a, b) reaches.

    Each round hooks every node to its least neighbour, follows that one step
    further, and replaces the nodes of the edges by what they hooked to, until
    no edge is left.  All of it is joins and aggregates with partial sums; a
    hub is aggregated in the map tasks first.
    """
    e = stage(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "edges")
    roots = stage(e.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node")), "roots")
    while not e.isEmpty():
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("p"))
        hook = stage(hook, "hooks")
        further = hook.select(F.col("v").alias("p"), F.col("p").alias("pp"))
        step = stage(hook.join(further, "p", "left").select("v", F.coalesce("pp", "p").alias("p")), "steps")
        roots = stage(roots.join(step.withColumnRenamed("v", "root"), "root", "left")
                      .select("node", F.coalesce("p", "root").alias("root")), "roots")
        a, b = step.select(F.col("v").alias("a"), F.col("p").alias("pa")), step.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        e = e.join(a, "a").join(b, "b").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
        e = stage(e.filter("a < b").distinct(), "edges")
    return roots
