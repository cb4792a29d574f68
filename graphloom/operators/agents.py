"""Rollouts of agents over a graph, with a policy that gives columns instead of a model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.components import ensure_checkpoints
from graphloom.operators.traverse import links_of


def rollout(start: DataFrame, edges: DataFrame, score: Callable[[DataFrame], DataFrame], steps: int = 2, width: int = 3, k: int = 10) -> DataFrame:
    """(question, agent, index, pos): answers of each agent in the order in which they were chosen.

    start: (question, agent, index) that a search gave. In each step an agent looks at the neighbours of its last nodes and
    keeps the `width` best that are new; score adds a column `score` to (question, agent, index). The steps are few and
    bounded, and each is a join of the agents' own nodes only, whose result checkpoint() cuts off.
    """
    ensure_checkpoints(start.sparkSession)
    seen = start.select("question", "agent", "index").distinct().withColumn("step", F.lit(0))
    front = seen
    own = Window.partitionBy("question", "agent").orderBy(F.desc("score"), "index")
    for step in range(1, steps + 1):
        both = links_of(edges, front).select("a", "b")
        near = front.join(both, front["index"] == both["a"]).select("question", "agent", F.col("b").alias("index")).distinct()
        fresh = near.join(seen.select("question", "agent", "index"), ["question", "agent", "index"], "left_anti")
        best = score(fresh).withColumn("n", F.row_number().over(own)).where(F.col("n") <= width)
        front = best.select("question", "agent", "index", F.lit(step).alias("step")).checkpoint()
        seen = seen.union(front)
    order = Window.partitionBy("question", "agent").orderBy("step", "index")
    return seen.withColumn("pos", F.row_number().over(order).cast("long")).where(F.col("pos") <= k).select("question", "agent", "index", "pos")


def without(candidates: DataFrame, node_types: bool = False, edge_types: bool = False, query: bool = False) -> DataFrame:
    """Candidates (index, name, type, edge, score) as an agent sees them that may not filter, or not ask.

    Without node or edge types these columns are null; without a query all scores are equal.
    """
    out = candidates
    if node_types:
        out = out.withColumn("type", F.lit(None).cast("string"))
    if edge_types:
        out = out.withColumn("edge", F.lit(None).cast("string"))
    return out.withColumn("score", F.lit(0.0)) if query else out
