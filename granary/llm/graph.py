"""Connected components of an edge table, by alternating large-star and small-star rounds.

Each round is two aggregations with map-side minima and two equi-joins; nothing is gathered per node, and the edges of
the busiest nodes are dealt over several tasks, so a node with a third of all edges is no task of its own. The number of rounds
grows with the logarithm of the longest path. A stage has as many tasks as the edges need, not as many as the session's shuffles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .deal import join_dealt

#: Edges to a task, where that makes more tasks than there are cores.
TASK_EDGES = 1 << 17


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(a, b)`` (longs, either direction, repeats and loops allowed) to ``(node, root)``.

    One row for each node with an edge to another node; ``root`` is the least node reachable. No edges: no rows.
    """
    spark = edges.sparkSession
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    current = scratch.materialize(pairs, "edges")
    count = current.count()
    for _ in range(max_rounds):
        tasks = max(spark.sparkContext.defaultParallelism, -(-count // TASK_EDGES))
        if _settled(current, tasks):
            break
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = join_dealt(both.where("b > a"), least, ["a"], "n", F.col("b"), tasks=tasks).select(F.col("b").alias("a"), F.col("m").alias("b")).coalesce(tasks).distinct()
        large = scratch.materialize(large.coalesce(tasks), "edges")
        root = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = join_dealt(large, root, ["a"], "n", F.col("b"), tasks=tasks).select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
        following = scratch.materialize(small.select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).where("a <> b").coalesce(tasks).distinct().coalesce(tasks), "edges")
        count = following.count()
        scratch.discard(current, large)
        current = following
    else:
        raise RuntimeError("components did not settle")
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def _settled(edges: DataFrame, tasks: int) -> bool:
    """Whether every node has one edge to a lesser node and none to a greater one, or the other way about: the edges are components then."""
    ends = edges.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(edges.select(F.col("b").alias("node"), F.lit(None).cast("long").alias("to")))
    seen = ends.groupBy("node").agg(F.min("to").alias("lo"), F.max("to").alias("hi"), F.max(F.col("to").isNull()).alias("above"))
    return seen.where("lo <> hi or (above and lo is not null)").coalesce(tasks).agg(F.count("*")).first()[0] == 0
