"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def _pairs(rows: DataFrame) -> DataFrame:
    """Each edge once, whichever way it was; loops go."""
    return rows.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, label for every node of ``edges`` (columns a, b); a component shares one label, which is one of its nodes.

    In each round a node goes to that of itself and its neighbours that is first in a hashed order, and from there once
    more; edges then join the nodes gone to, and those within one go. What is left shrinks by a factor from round to
    round, whatever the shape. Rounds are written out, so a lost executor costs one at most. Joins are between written
    tables, whose skewed partitions (a node with very many neighbours) Spark splits.
    """
    left = stage(_pairs(edges), "edges")
    labels = left.select(F.col("a").alias("node"), F.col("b").alias("label")).limit(0)
    first = True
    rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("n"))
    for _ in range(rounds):
        if left.isEmpty():
            return labels
        both = left.select(F.col("a").alias("node"), F.col("b").alias("near")).union(left.select("b", "a"))
        near = both.groupBy("node").agg(F.min(rank("near")).alias("m"))
        parents = stage(near.select("node", F.least("m", rank("node"))["n"].alias("up")), "parents")
        above = parents.select(F.col("node").alias("of"), F.col("up").alias("to"))
        gone = stage(parents.join(above, parents["up"] == above["of"]).select(F.col("node").alias("of"), "to"), "gone-to")
        if first:
            labels, first = gone.select(F.col("of").alias("node"), F.col("to").alias("label")), False
        else:
            moved = labels.join(gone, labels["label"] == gone["of"], "left")
            labels = stage(moved.select("node", F.coalesce("to", "label").alias("label")), "labels")
        ends = left.join(gone, left["a"] == gone["of"]).select(F.col("to").alias("a"), "b")
        ends = ends.join(gone, ends["b"] == gone["of"]).select("a", F.col("to").alias("b"))
        left = stage(_pairs(ends), "edges")
    raise RuntimeError(f"edges are left after {rounds} rounds")
