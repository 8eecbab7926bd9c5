"""Connected components of a distributed edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import saved, spread_join


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's higher neighbours go to the lowest node among itself and its neighbours. Lows are combined before the
    shuffle, so a hub costs each task one row; a node that has no lower neighbour keeps its arcs without being looked up."""
    arcs = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = arcs.groupBy("a").agg(F.min("b").alias("low")).where("low < a")
    return spread_join(arcs.where("b > a"), low, "a", "b", "left").select(F.col("b").alias("a"), F.coalesce("low", "a").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node's lower neighbours, and the node, go to the lowest of them. A node with one of them is left as it is."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("low"), F.max("b").alias("most"))
    moved = spread_join(down, low.where("most > low").select("a", "low"), "a", "b").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.union(low.select("a", F.col("low").alias("b")))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` to ``(node, component)``: each node that has an edge, with the least node it reaches.

    Self-loops, repeated edges and either direction are allowed; rows with a null end are ignored; an
    empty table gives an empty one. Rounds repeat until the edge set is a forest of stars and no longer
    changes; each round is written to the shared folder, so lineage stays short and a lost executor costs
    at most one round. A hub's arcs are dealt to several tasks where they meet its lowest neighbour."""
    clean = edges.select("a", "b").where("a is not null and b is not null and a <> b")
    now = saved(clean.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before, after = None, _state(now)
    while after[0] and after != before:
        now = saved(_small_star(_large_star(now)).where("a <> b").distinct(), "edges", instead_of=[now])
        before, after = after, _state(now)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
