"""Connected components of an edge table by iterated hooking and contraction in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.llm.common import materialised

# Rounds before giving up; each at least halves the nodes that still have edges, and each jump halves a chain of hooks.
MAX_ROUNDS = 64


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the edges ``a, b``: root is the smallest node that it reaches.

    Each round every node hooks onto its smallest neighbour if that is smaller than itself, follows the hooks to their end by
    pointer jumping, and the edges are then contracted to those between different ends. So the edges within a dense group are joined once, not
    in every round. Minimums and distinct edges are partially aggregated before each shuffle; nothing but the question
    whether edges are left comes to the driver.
    """
    a, b = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    edges = materialised(edges.select(a, b).filter("a < b").distinct())
    names = None
    for _ in range(MAX_ROUNDS):
        both = edges.union(edges.select("b", "a"))
        hooks = materialised(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select(
            "node", F.least("node", "m").alias("to")))
        step = hooks.withColumn("moved", F.lit(True))
        while not step.filter("moved").isEmpty():
            far = step.select(F.col("node").alias("to"), F.col("to").alias("far"))
            step = materialised(step.join(far, "to").select(
                "node", F.col("far").alias("to"), (F.col("far") != F.col("to")).alias("moved")))
        step = step.select("node", "to")
        if names is None:
            names = step.withColumnRenamed("to", "root")
        else:
            on = step.select(F.col("node").alias("root"), "to")
            names = names.join(on, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        names = materialised(names)
        for end in ("a", "b"):
            edges = edges.join(step.select(F.col("node").alias(end), F.col("to").alias(f"_{end}")), end)
        edges = materialised(edges.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).filter(
            "a < b").distinct())
        if edges.isEmpty():
            return names
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
