"""Connected components by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import discard, materialise


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every end of an edge (a, b); a component is named by its least id.

    Each round hooks every end to the least of itself and its neighbours, follows those labels to their roots, which
    takes the logarithm of a path's length, and goes on with the edges between different roots, once each. A star or
    a dense group is one root after the first round, so that its edges are joined once, not once a round. Labels stay
    on the executors; only whether any changed comes to the driver. Tables are deleted when the next one is written.
    """
    left = materialise(_between(edges))
    placed = None
    while True:
        labels = _roots(left)
        if placed is None:
            placed = labels
        else:
            moved = labels.select(F.col("id").alias("component"), F.col("component").alias("root"))
            new = materialise(placed.join(moved, "component", "left").select("id", F.coalesce("root", "component").alias("component")))
            discard(placed)
            placed = new
        a, b = (labels.select(F.col("id").alias(x), F.col("component").alias(f"root_{x}")) for x in "ab")
        rest = materialise(_between(left.join(a, "a").join(b, "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))))
        discard(left, *([labels] if labels is not placed else []))
        left = rest
        if left.isEmpty():
            discard(left)
            return placed.select("id", "component")


def _between(edges: DataFrame) -> DataFrame:
    """Each edge between different ends once, the lesser end first."""
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _roots(edges: DataFrame) -> DataFrame:
    """(id, component) of every end: where the labels lead when each end points to the least of itself and its neighbours."""
    near = edges.select(F.col("b").alias("id"), F.col("a").alias("via")).union(edges.select("a", "a"))
    labels = materialise(near.groupBy("id").agg(F.min("via").alias("component")))
    while True:
        far = labels.select(F.col("id").alias("component"), F.col("component").alias("far"))
        new = materialise(labels.join(far, "component").select("id", F.col("far").alias("component"), (F.col("far") < F.col("component")).alias("moved")))
        discard(labels)
        labels = new
        if labels.where("moved").isEmpty():
            return labels
