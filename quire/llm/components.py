"""Connected components of a graph by joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm._common import discard, written


def components(edges: DataFrame) -> DataFrame:
    """``node, component``: for every node of ``edges (a, b)`` the smallest node reachable.

    Each step lowers every node's label to the least of its neighbours' labels,
    passes that on to the node that the label names, and follows labels once, so
    the number of steps grows with the logarithm of the longest chain.  Minima are
    combined before each shuffle, so a node with very many links costs no task more
    than the partial results of the others.  Each step is written to the shared folder.
    Edges with a null end do not count.
    """
    edges = edges.select("a", "b").dropna()
    both = written(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    label = written(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("component")), "labels")
    while True:
        near = both.join(label, both["b"] == label["node"]).groupBy("a").agg(F.min("component").alias("least"))
        seen = written(label.join(near, label["node"] == near["a"]).select("node", "component", F.least("component", "least").alias("least")), "seen")
        hooked = seen.groupBy("component").agg(F.min("least").alias("least")).select(F.col("component").alias("root"), F.col("least").alias("hook"))
        lower = seen.join(hooked, seen["component"] == hooked["root"], "left").select("node", F.least("least", F.coalesce("hook", "least")).alias("component"), F.col("component").alias("old"))
        lower = written(lower, "lower")
        parent = lower.select(F.col("node").alias("up"), F.col("component").alias("above"))
        after = lower.join(parent, lower["component"] == parent["up"], "left").select("node", F.least("component", F.coalesce("above", "component")).alias("component"), "old")
        after = written(after, "labels")
        for df in (label, seen, lower):
            discard(df)
        label = after
        if after.filter(F.col("component") != F.col("old")).isEmpty():
            discard(both)
            return after.select("node", "component")
