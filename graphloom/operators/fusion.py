"""Fusion of ranked lists and of agents' votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def weighted_ranks(lists: DataFrame, kappa: int = 60, digits: int = 6) -> DataFrame:
    """(query, item, score, rank) of rows (query, item, rank, weight): the sum of weight / (kappa + rank) over lists."""
    part = F.col("weight").cast("double") / (F.lit(kappa) + F.col("rank"))
    out = lists.groupBy("query", "item").agg(F.round(F.sum(part), digits).alias("score"))
    own = Window.partitionBy("query").orderBy(F.desc("score"), "item")
    return out.withColumn("rank", F.row_number().over(own).cast("long"))


def votes(lists: DataFrame, tie: str = "flat", kappa: int = 60) -> DataFrame:
    """(question, node, votes, place, rank) of answers (question, agent, pos, node): nodes by votes, then by `tie`.

    tie: "flat", the first place when all agents' lists are laid end to end; "first_agent", the place with the first agent
    that has the node; "min_depth", the smallest place with any agent; "reciprocal" ranks by the sum of 1 / (kappa + place)
    instead of votes. Remaining ties go to the smaller node.
    """
    flat = F.row_number().over(Window.partitionBy("question").orderBy("agent", "pos"))
    rows = lists.withColumn("flat", flat.cast("long"))
    first = F.min(F.struct("agent", "pos"))
    place = {"flat": F.min("flat"), "first_agent": F.struct(first["agent"], first["pos"]), "min_depth": F.min("pos")}
    if tie == "reciprocal":
        out = rows.groupBy("question", "node").agg(F.count_distinct("agent").alias("votes"), F.round(F.sum(1.0 / (F.lit(kappa) + F.col("pos"))), 9).alias("place"))
        order: list[Column] = [F.desc("place"), F.col("node")]
    else:
        out = rows.groupBy("question", "node").agg(F.count("*").alias("votes"), place[tie].alias("place"))
        order = [F.desc("votes"), F.col("place"), F.col("node")]
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("question").orderBy(*order)).cast("long"))


def rescored(hits: DataFrame, weight: float = 1.5) -> DataFrame:
    """Hits (score, matches, semantic, similarity, confidence) with `new_score`: matching categories gain, others lose."""
    base = F.col("score") * F.when(F.col("matches"), weight).otherwise(0.7 * weight)
    base = base * F.when(F.col("semantic"), 1 + 0.3 * F.col("similarity")).otherwise(1.0)
    return hits.withColumn("new_score", base * (1 + 0.2 * F.coalesce("confidence", F.lit(0.0))))


def first_of_each_text(rows: DataFrame, text: str, order: str) -> DataFrame:
    """The first row of each trimmed text."""
    own = Window.partitionBy(F.trim(F.col(text))).orderBy(order)
    return rows.withColumn("_n", F.row_number().over(own)).where("_n = 1").drop("_n")


def last_of_each(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    own = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_n", F.row_number().over(own)).where("_n = 1").drop("_n")


def reranked(rows: DataFrame, score: Column, group: str, text: str, order: str, k: int) -> DataFrame:
    """Rows without repeated texts in their group, the best `k` of each by `score`; groups of one row pass as they are."""
    once = Window.partitionBy(group, F.trim(F.col(text))).orderBy(order)
    unique = rows.withColumn("_n", F.row_number().over(once)).where("_n = 1").drop("_n").withColumn("new_score", score)
    own = Window.partitionBy(group).orderBy(F.desc("new_score"), order)
    return unique.withColumn("rank", F.row_number().over(own).cast("long")).where(F.col("rank") <= k)
