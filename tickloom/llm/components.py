"""Connected components by contraction, with nothing on the driver but 'is an edge left?'."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for all nodes of ``edges``; the component is its smallest node.

    Each round hooks every node to its smallest neighbour, follows these hooks four steps, and renames the
    edges by what it finds. Edges within one name vanish, so the graph shrinks geometrically. Hot nodes are
    no trouble: minima are taken before the shuffle and Spark splits the joins.
    """
    pairs = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b").distinct()
    pairs = materialise(pairs)
    names = materialise(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().select("node", F.col("node").alias("component")))
    while not pairs.isEmpty():
        both = pairs.union(pairs.select("b", "a"))
        hook = materialise(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to")))
        for _ in range(2):
            then = hook.select(F.col("a").alias("to"), F.col("to").alias("next"))
            before, hook = hook, materialise(hook.join(then, "to").select("a", F.col("next").alias("to")))
            discard(before)
        before, names = names, materialise(names.join(hook, names["component"] == hook["a"], "left").select("node", F.coalesce("to", "component").alias("component")))
        old, pairs = pairs, pairs.join(hook.withColumnRenamed("to", "x"), "a").join(hook.select(F.col("a").alias("b"), F.col("to").alias("y")), "b")
        pairs = materialise(pairs.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        discard(before, old, hook)
    return names
