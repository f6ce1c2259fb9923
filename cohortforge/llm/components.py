"""Connected components of large edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortforge.llm.tables import written


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """One half round: hang each node's neighbours on its smallest one.

    ``edges`` has ``a > b``. The large star moves larger neighbours, the small star
    smaller ones. Minima are summed up before the shuffle, and the join that brings them back
    may split a node with very many neighbours.
    """
    if larger:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("b")))
        least = least.groupBy("a").agg(F.min("b").alias("m"))
        moved = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        joined = edges.join(least, "a")
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b"))
        moved = moved.unionAll(least.select("a", F.col("m").alias("b")))
    return moved.where(F.col("a") > F.col("b")).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, component`` for every node of ``edges`` (``a, b``); component is its smallest node.

    Alternates large and small stars until nothing moves; each round is a written table.
    Repeated edges and loops do no harm; a node with loops only is its own component.
    """
    loops = edges.where(F.col("a") == F.col("b")).select(F.col("a").alias("node"), F.col("a").alias("component"))
    ordered = edges.where(F.col("a") != F.col("b"))
    ordered = ordered.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    state, before = written(ordered, "edges"), None
    for _ in range(most_rounds):
        seen = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == before:
            break
        before = seen
        state = written(_star(_star(state, True), False), "edges")
    else:
        raise RuntimeError("components did not settle")
    named = state.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = state.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return named.unionAll(roots).unionAll(loops).groupBy("node").agg(F.min("component").alias("component"))
