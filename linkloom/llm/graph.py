"""Connected components by contraction, in DataFrame operations.

Each round points every vertex to the least of itself and its neighbours, follows
these pointers by doubling until all end at vertices that point to themselves, and
replaces edges by those of the ends; edges within an end vanish. A vertex left with
edges has taken in at least one other, so a round at least halves the vertices and
a chain of any order takes a logarithm of doublings. The rounds' maps, one after
the other, give each vertex the least vertex of its component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import skew_lookup, written


def _ends(parents: DataFrame) -> DataFrame:
    """(a, to) with the end of each vertex's pointers; every ``to`` is itself an ``a``."""
    while True:
        further = parents.select(F.col("a").alias("to"), F.col("to").alias("end"))
        doubled = written(skew_lookup(parents, "to", further).select("a", "to", "end"), "doubled")
        settled = doubled.filter("end <> to").isEmpty()
        parents = doubled.select("a", F.col("end").alias("to"))
        if settled:
            return parents


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every vertex of ``edges(a, b)``; component is the least vertex reachable."""
    left = written(edges.select("a", "b").filter("a <> b"), "edges")
    labels = None
    while True:
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = _ends(written(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("to")), "parents"))
        moved = parents.select(F.col("a").alias("component"), "to")
        if labels is None:
            labels = parents.select(F.col("a").alias("node"), F.col("to").alias("component"))
        else:
            labels = written(skew_lookup(labels, "component", moved).select("node", F.coalesce("to", "component").alias("component")), "labels")
        heads = written(skew_lookup(left, "a", parents).select(F.col("to").alias("a"), "b"), "heads")
        tails = skew_lookup(heads, "b", parents.select(F.col("a").alias("b"), F.col("to").alias("t"))).select("a", F.col("t").alias("b"))
        left = written(tails.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        if left.isEmpty():
            return labels
