"""Connected components by repeated contraction, with DataFrame joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.session import discard, materialize


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 100) -> DataFrame:
    """``edges(a, b)`` of longs -> ``(node, component)``: for every node of an edge the smallest node
    that it reaches.

    Each round sends every node to the smallest of itself and its neighbours, follows these steps
    four times, and renames the ends of all edges, so that a sorted chain shrinks to a quarter. The
    minimum is taken before the shuffle, so a node with very many neighbours costs one row for each
    task. Empty edges give an empty result; repeated edges and loops do no harm; rows with a null
    end are ignored.
    """
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null").distinct()
    e = materialize(e, "cc-edges")
    # Loops give their node a label, but are no edges.
    labels = materialize(e.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node")), "cc-labels")
    for _ in range(most_rounds):
        if e.where("a <> b").isEmpty():
            discard(e)
            return labels
        old, one = e, labels
        step = (
            e.where("a <> b").select("a", "b").union(e.select(F.col("b"), F.col("a")))
            .groupBy("a").agg(F.min("b").alias("low"))
            .select(F.col("a").alias("was"), F.least("a", "low").alias("goal"))
        )
        was = step = materialize(step, "cc-step")
        for _ in range(2):
            on = step.select(F.col("was").alias("goal"), F.col("goal").alias("end"))
            step = step.join(on, "goal", "left").select("was", F.coalesce("end", "goal").alias("goal"))
        step = materialize(step, "cc-step")
        labels = labels.join(step, labels["component"] == step["was"], "left").select("node", F.coalesce("goal", "component").alias("component"))
        labels = materialize(labels, "cc-labels")
        left = step.select(F.col("was").alias("a"), F.col("goal").alias("na"))
        right = step.select(F.col("was").alias("b"), F.col("goal").alias("nb"))
        e = e.join(left, "a").join(right, "b").select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b"))
        e = materialize(e.where("a <> b").distinct(), "cc-edges")
        discard(old, one, was, step)
    raise RuntimeError(f"edges are left after {most_rounds} rounds")
