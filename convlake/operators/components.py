"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import store


#: Edges that one task handles faster than the shuffles of a round take.
_FEW = 100_000


def _moves(edges: DataFrame, k: int) -> DataFrame:
    """(u, up): each node and the one of itself and its neighbours with most neighbours (by powers of two), ties by a hash of round ``k``."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    degree = both.groupBy("u").agg(F.floor(F.log2(F.count(F.lit(1)))).alias("d"))
    rank = lambda node: F.struct("d", F.xxhash64(node, F.lit(k)).alias("h"), F.col(node).alias("up"))
    seen = both.join(degree.withColumnRenamed("u", "v"), "v").select("u", rank("v").alias("r")).unionByName(degree.select("u", rank("u").alias("r")))
    return seen.groupBy("u").agg(F.max("r").alias("r")).select("u", F.col("r.up").alias("up"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """``node`` and ``component``, the smallest node that it is linked to, for each node that has an edge to another.

    Rows with a null end and edges from a node to itself are ignored. In a round every node moves to one of its
    neighbours or stays; edges are renamed, and those within one node leave, with the nodes that have no other. So what a round writes shrinks:
    a star is gone after one, a path loses a constant share whatever its order. Moves are followed at the end, from the last
    round back. What a node's edges say is aggregated before it is shuffled, and joins back are ones that Spark can split.
    Up to 100,000 edges, counted in every round, are one partition and not shuffled.
    """
    edges = store(edges.where(f"{a} <> {b}").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    moves: list[DataFrame] = []
    while n := edges.count():
        if len(moves) == most_rounds:
            raise RuntimeError("components did not settle")
        whole = (lambda d: d.coalesce(1)) if n <= _FEW else (lambda d: d)
        edges = whole(edges)
        moves.append(store(_moves(edges, len(moves)), "moves"))
        to = lambda end: whole(moves[-1]).select(F.col("u").alias(end), F.col("up").alias(f"_{end}"))
        moved = edges.join(to("u"), "u").join(to("v"), "v").where("_u <> _v")
        edges = store(moved.select(F.greatest("_u", "_v").alias("u"), F.least("_u", "_v").alias("v")).distinct(), "edges")
    if not moves:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    ends = moves[-1]
    for step in reversed(moves[:-1]):
        later = ends.select(F.col("u").alias("up"), F.col("up").alias("_end"))
        ends = step.join(later, "up", "left").select("u", F.coalesce("_end", "up").alias("up"))
    least = ends.groupBy("up").agg(F.min("u").alias("component"))
    return ends.join(least, "up").select(F.col("u").alias("node"), "component")
