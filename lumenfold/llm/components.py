"""Connected components of a distributed edge table, by hooking and pointer jumping; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.session import discard, materialize


def _follow(df: DataFrame, column: str, parents: DataFrame) -> DataFrame:
    """df with column replaced by its parent where it has one."""
    to = parents.select(F.col("node").alias("__node"), F.col("parent").alias("__parent"))
    met = df.join(to, df[column] == to["__node"], "left")
    return met.withColumn(column, F.coalesce("__parent", column)).drop("__node", "__parent")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every end of an edge (a, b): component is the smallest node that can be reached.

    In each round every root hooks to its smallest neighbour, if that is smaller; the chains of hooks are
    shortened by pointer jumping, and edges are redrawn between roots until none is left. Each step is written
    to the shared folder. Edges with a null end, loops and repeated edges change nothing.
    """
    left = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    current = left = materialize(left, "edges")
    labels = left.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node"))
    labels = materialize(labels, "labels")
    while not left.isEmpty():
        parents = hooks = materialize(left.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("parent")), "hooks")
        while True:
            two = parents.select(F.col("node").alias("__node"), F.col("parent").alias("__parent"))
            jumped = parents.join(two, parents["parent"] == two["__node"], "left").select(
                "node", F.coalesce("__parent", "parent").alias("parent"), F.col("__parent").isNotNull().alias("moved")
            )
            jumped = materialize(jumped, "hooks")
            discard(hooks)
            hooks, parents = jumped, jumped.drop("moved")
            if jumped.where("moved").isEmpty():
                break
        old = labels
        labels = materialize(_follow(labels, "component", parents), "labels")
        discard(old)
        redrawn = _follow(_follow(left, "a", parents), "b", parents)
        # repeated edges stay: making them distinct would gather a large component's in one task, and there are no more of them than before
        left = redrawn.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b")
        before, left = current, materialize(left, "edges")
        discard(before, hooks)
        current = left
    return labels
