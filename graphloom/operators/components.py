"""Connected components and communities of an undirected graph."""

from __future__ import annotations

import tempfile

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ensure_checkpoints(spark) -> None:
    """Uses the folder in spark.checkpoint.dir; a temporary one only where that is unset and all of Spark is one process."""
    if spark.sparkContext.getCheckpointDir() is None:
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(found or f"file://{tempfile.mkdtemp(prefix='graphloom-')}")


def components(nodes: DataFrame, links: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(index, component): the smallest index that links (a, b) lead to.

    Labels spread along links and then jump to their own label's label, so the rounds grow with the logarithm of a
    component's width. Each round is cut off by checkpoint().
    """
    ensure_checkpoints(nodes.sparkSession)
    both = links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct().checkpoint()
    now = nodes.select(F.col("index"), F.col("index").alias("component")).distinct().checkpoint()
    for _ in range(most_rounds):
        near = both.join(now.withColumnRenamed("index", "b"), "b").groupBy(F.col("a").alias("index")).agg(F.min("component").alias("near"))
        spread = now.join(near, "index", "left").select("index", F.col("component").alias("old"), F.least("component", F.coalesce("near", "component")).alias("component"))
        jump = spread.select(F.col("index").alias("component"), F.col("component").alias("further"))
        after = spread.join(jump, "component", "left").select("index", "old", F.coalesce("further", "component").alias("component")).checkpoint()
        changed = after.where("old <> component").limit(1).count()
        now = after.select("index", "component")
        if not changed:
            return now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def label_propagation(nodes: DataFrame, links: DataFrame, rounds: int = 6, resolution: float = 1.0) -> DataFrame:
    """(index, community): in each round half of the nodes, by parity of a hash, take the commonest label around them.

    Ties go to the smallest label. A weight of 1 / resolution for its own label keeps a node where it is. Alternating
    halves do not swing on two-sided graphs. The result is the same for the same input. Where the nodes fit, no link is moved.
    """
    from graphloom.operators import sent_links as L

    ensure_checkpoints(nodes.sparkSession)
    both = links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct().checkpoint()
    now = nodes.select("index", F.col("index").alias("community")).distinct().checkpoint()
    if now.schema["index"].dataType.typeName() == "long" and now.where("index is not null").count() <= L.MOST_NODES:
        listed = now.where("index is not null").select(F.col("index").alias("a"))
        known = both.join(listed, "a", "left_semi").join(listed.withColumnRenamed("a", "b"), "b", "left_semi").select("a", "b", F.lit(1).cast("long").alias("w"))
        near = L.Sent.of(known, np.sort(listed.toArrow().column(0).to_numpy()))
        found = near.labels(rounds, resolution)
        near.free()
        return found
    for k in range(rounds):
        votes = both.join(now.withColumnRenamed("index", "b"), "b").groupBy(F.col("a").alias("index"), "community").agg(F.count("*").cast("double").alias("n"))
        votes = votes.union(now.select("index", "community", F.lit(1.0 / resolution)))
        votes = votes.groupBy("index", "community").agg(F.sum("n").alias("n"))
        best = votes.groupBy("index").agg(F.min_by("community", F.struct(-F.col("n"), F.col("community"))).alias("best"))
        turn = F.pmod(F.crc32(F.col("index").cast("string")), F.lit(2)) == k % 2
        now = now.join(best, "index").select("index", F.when(turn, F.col("best")).otherwise(F.col("community")).alias("community")).checkpoint()
    return now


def modularity(members: DataFrame, links: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(modularity, communities) of members (index, community) over undirected links (a, b), loops and repeats left out."""
    simple = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    ends = simple.join(members.select(F.col("index").alias("a"), F.col("community").alias("ca")), "a").join(members.select(F.col("index").alias("b"), F.col("community").alias("cb")), "b")
    inner = ends.where("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.count("*").alias("inner"))
    degree = ends.select(F.explode(F.array("ca", "cb")).alias("community")).groupBy("community").agg(F.count("*").alias("degree"))
    total = degree.agg((F.sum("degree") / 2).alias("m"))
    rows = degree.join(inner, "community", "left").crossJoin(F.broadcast(total))
    part = F.coalesce("inner", F.lit(0)) / F.col("m") - resolution * F.pow(F.col("degree") / (2 * F.col("m")), 2)
    return rows.agg(F.sum(part).alias("modularity"), F.count("*").alias("communities"))


def resolutions(gamma: float, levels: int) -> list[float]:
    """The resolution of each level, half of the one before."""
    return [gamma * 0.5**level for level in range(levels)]


def community_levels(nodes: DataFrame, links: DataFrame, gamma: float = 1.0, levels: int = 2, rounds: int = 6) -> DataFrame:
    """(level, index, community), every level found on its own."""
    out = None
    for level, resolution in enumerate(resolutions(gamma, levels)):
        part = label_propagation(nodes, links, rounds, resolution).select(F.lit(level).alias("level"), "index", "community")
        out = part if out is None else out.union(part)
    return out


def materialised(members: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
    """(id, level, community, entity_count, summary); a summary of the same id in `earlier` (id, summary) stays."""
    rows = members.groupBy("level", "community").agg(F.count("*").alias("entity_count"))
    rows = rows.withColumn("id", F.concat(F.lit("community_lvl"), F.col("level").cast("string"), F.lit("_"), F.col("community").cast("string")))
    if earlier is None:
        return rows.withColumn("summary", F.lit("")).select("id", "level", "community", "entity_count", "summary")
    return rows.join(earlier.select("id", "summary"), "id", "left").select("id", "level", "community", "entity_count", F.coalesce("summary", F.lit("")).alias("summary"))


def inner_edges(edges: DataFrame, members: DataFrame, limit: int | None = None) -> DataFrame:
    """(community, start_node_index, end_node_index, type, rank): edges with both ends in one community, up to `limit` of each."""
    if not isinstance(edges, DataFrame):  # a graph that is not stored
        edges = edges.between(members.select("index"))
    if "a" in edges.columns:  # links, which have each edge from both of its ends
        edges = edges.where("forward").select(F.col("a").alias("start_node_index"), F.col("b").alias("end_node_index"), "type")
    a = members.select(F.col("index").alias("start_node_index"), "community")
    b = members.select(F.col("index").alias("end_node_index"), F.col("community").alias("other"))
    found = edges.join(a, "start_node_index").join(b, "end_node_index").where("community = other").drop("other")
    own = Window.partitionBy("community").orderBy("start_node_index", "end_node_index", "type")
    found = found.withColumn("rank", F.row_number().over(own).cast("long")).select("community", "start_node_index", "end_node_index", "type", "rank")
    return found if limit is None else found.where(F.col("rank") <= limit)


def reports(members: DataFrame, nodes: DataFrame, edges: DataFrame, most_entities: int = 20, most_edges: int = 30) -> DataFrame:
    """(community, entity_count, context): numbered entities and relationships of each community as a prompt's text."""
    named = members.join(nodes.select("index", "name", "type"), "index")
    own = Window.partitionBy("community").orderBy("index")
    top = named.withColumn("n", F.row_number().over(own)).where(F.col("n") <= most_entities)
    entities = top.groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", F.concat(F.lit("- "), "name", F.lit(" ("), "type", F.lit(")")).alias("line")))), lambda x: x["line"]), "\n").alias("entities"))
    counts = members.groupBy("community").agg(F.count("*").alias("entity_count"))
    line = F.concat(F.lit("[R"), F.col("rank").cast("string"), F.lit("] "), F.col("start_node_index").cast("string"), F.lit(" -["), "type", F.lit("]-> "), F.col("end_node_index").cast("string"))
    links = inner_edges(edges, members, most_edges).groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n").alias("links"))
    out = counts.join(entities, "community").join(links, "community", "left")
    return out.select("community", "entity_count", F.concat(F.lit("Entities:\n"), "entities", F.lit("\nRelationships:\n"), F.coalesce("links", F.lit(""))).alias("context"))
