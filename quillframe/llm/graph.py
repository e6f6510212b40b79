"""Connected components by contraction, in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge (a, b) between two nodes; nodes that reach each other have the same root, one of them.

    In each round every node goes to the first of itself and its neighbours, by a fixed hashed order, and on to where that
    one goes. Edges between what is left replace the edges; parallel ones and loops go, so that rounds shrink. Where each node went is put
    together from the last round back.
    """
    left, rounds = _simple(edges), []
    while not left.isEmpty():
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("n"))
        near = stored(both.groupBy("a").agg(F.min(rank("b")).alias("near")).select("a", F.least(rank("a"), F.col("near")).getField("n").alias("to")), "near")
        went = stored(near.join(near.select(F.col("a").alias("to"), F.col("to").alias("on")), "to").select(F.col("a").alias("node"), F.col("on").alias("root")), "went")
        rounds.append(went)
        by_a = left.join(went.select(F.col("node").alias("a"), F.col("root").alias("a_root")), "a")
        left = _simple(by_a.join(went.select(F.col("node").alias("b"), F.col("root").alias("b_root")), "b").select(F.col("a_root").alias("a"), F.col("b_root").alias("b")))
    if not rounds:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = rounds.pop()
    while rounds:
        later = roots.select(F.col("node").alias("root"), F.col("root").alias("later"))
        roots = rounds.pop().join(later, "root", "left").select("node", F.coalesce("later", "root").alias("root"))
    return roots


def _simple(edges: DataFrame) -> DataFrame:
    """Each edge once, from its smaller to its larger end."""
    return stored(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
