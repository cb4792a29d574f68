"""Traversals of a typed graph, read without regard to direction.

A graph is a table of edges (start_node_index, end_node_index, type) or, so that a step costs one scan, of links
(a, b, type, forward), which have each edge from both of its ends. Where a graph's tables can say what is linked to some nodes
without the rest, it is an object with `every`, `starting_at` and `between` (see `star.OpenLinks`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.components import ensure_checkpoints


#: Seeds up to which they are named in a filter on the links.
NAMED_SEEDS = 1000


def undirected(edges: DataFrame) -> DataFrame:
    """(a, b, type, forward): each edge from both of its ends; a table of links stays as it is."""
    if not isinstance(edges, DataFrame):
        return edges.every()
    if "a" in edges.columns:
        return edges
    out = edges.select(F.col("start_node_index").alias("a"), F.col("end_node_index").alias("b"), "type", F.lit(True).alias("forward"))
    return out.union(edges.select("end_node_index", "start_node_index", "type", F.lit(False)))


def directed(edges: DataFrame) -> DataFrame:
    """(start_node_index, end_node_index, type): each edge once; a table of edges stays as it is."""
    if not isinstance(edges, DataFrame):
        edges = edges.every()
    if "a" not in edges.columns:
        return edges
    return edges.where("forward").select(F.col("a").alias("start_node_index"), F.col("b").alias("end_node_index"), "type")


def node_types(nodes: DataFrame) -> DataFrame:
    return nodes.select("type").distinct()


def edge_types(edges: DataFrame) -> DataFrame:
    return directed(edges).select("type").distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """(index, degree, neighbours): edge ends, and distinct other nodes."""
    return undirected(edges).groupBy(F.col("a").alias("index")).agg(F.count("*").alias("degree"), F.count_distinct("b").alias("neighbours"))


def links_of(edges: DataFrame, seeds: DataFrame, name: str = "index") -> DataFrame:
    """The links that may start at a seed: with few seeds, those that do, by a filter that the scan itself applies.

    Links stored in the order of their ends are read in the row groups that hold the seeds. With over `NAMED_SEEDS` seeds
    all links come back, and the join that follows narrows them.
    """
    few = [r[0] for r in seeds.select(name).where(F.col(name).isNotNull()).distinct().limit(NAMED_SEEDS + 1).collect()]
    if not isinstance(edges, DataFrame):
        return edges.starting_at(seeds.select(F.col(name).alias("index")) if len(few) > NAMED_SEEDS else sorted(few))
    both = undirected(edges)
    return both if len(few) > NAMED_SEEDS else both.where(F.col("a").isin(sorted(few)))


def neighbours(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, index) of the distinct nodes one edge away from each seed (column index)."""
    wanted = seeds.select(F.col("index").alias("seed")).distinct()
    return links_of(edges, wanted, "seed").join(wanted, F.col("a") == F.col("seed"), "inner").select("seed", F.col("b").alias("index")).distinct()


def within_hops(edges: DataFrame, seeds: DataFrame, k: int) -> DataFrame:
    """(index, hops): nodes at most `k` edges from any seed, seeds included, with the fewest edges.

    Each step joins the last step's new nodes only, which checkpoint() cuts off, so the plan grows by one scan of the links
    a step.
    """
    ensure_checkpoints(edges.sparkSession)
    reached = seeds.select(F.col("index").cast("long").alias("index")).distinct().withColumn("hops", F.lit(0))
    front = reached
    for hop in range(1, k + 1):
        step = links_of(edges, front).select("a", "b").join(front.select(F.col("index").alias("a")), "a").select(F.col("b").alias("index")).distinct()
        front = step.join(reached.select("index"), "index", "left_anti").withColumn("hops", F.lit(hop))
        front = front.checkpoint() if k > 1 else front
        reached = reached.union(front)
    return reached


def subgraph_edges(edges: DataFrame, inside: DataFrame, boundary: bool = True) -> DataFrame:
    """Distinct edges (start_node_index, end_node_index, type) with either end among `inside` (boundary), or with both."""
    ends = inside.select("index").distinct()
    if not isinstance(edges, DataFrame):
        ensure_checkpoints(edges.sparkSession)
        ends = ends.checkpoint()  # every table of the graph is narrowed by it
        if not boundary:
            return edges.between(ends)
        edges = edges.starting_at(ends)
    found = undirected(edges).join(ends.withColumnRenamed("index", "a"), "a", "left_semi")
    if not boundary:
        found = found.where("forward").join(ends.withColumnRenamed("index", "b"), "b", "left_semi")
    start, end = (F.when(F.col("forward"), F.col(x)).otherwise(F.col(y)) for x, y in (("a", "b"), ("b", "a")))
    return found.select(start.alias("start_node_index"), end.alias("end_node_index"), "type").distinct()


def short_paths(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(src, dst, middle, first, second): paths of one or two edges between the nodes of each pair (src, dst).

    A direct edge has no middle and no second type. The walk starts from the pairs' own neighbourhoods, so a hub elsewhere
    costs nothing. A pair of one node has no path. Each path counts once whatever its edges' directions.
    """
    ends = pairs.where("src <> dst").select("src", "dst").distinct()
    both = links_of(edges, ends.select(F.explode(F.array("src", "dst")).alias("index"))).select("a", "b", "type")
    out = ends.join(both, F.col("a") == F.col("src")).select("src", "dst", F.col("b").alias("next"), F.col("type").alias("first")).distinct()
    direct = out.where("next = dst").select("src", "dst", F.lit(None).cast("long").alias("middle"), "first", F.lit(None).cast("string").alias("second"))
    back = ends.join(both, F.col("a") == F.col("dst")).select("src", "dst", F.col("b").alias("next"), F.col("type").alias("second")).distinct()
    mediated = out.join(back, ["src", "dst", "next"]).where("next <> src and next <> dst").select("src", "dst", F.col("next").alias("middle"), "first", "second")
    return direct.union(mediated)


def one_per_triplet(triplets: DataFrame, order: list[Column]) -> DataFrame:
    """The first row, by `order`, of each (source, type, target) and its reverse."""
    key = Window.partitionBy(F.least("source", "target"), "type", F.greatest("source", "target")).orderBy(*order)
    return triplets.withColumn("_n", F.row_number().over(key)).where("_n = 1").drop("_n")


def expand(edges: DataFrame, seeds: DataFrame, limit: int) -> DataFrame:
    """(seed, type, other, forward, rank): up to `limit` edges of each seed, by type, other end and direction."""
    wanted = seeds.select(F.col("index").alias("seed")).distinct()
    found = links_of(edges, wanted, "seed").join(wanted, F.col("a") == F.col("seed")).select("seed", "type", F.col("b").alias("other"), "forward")
    own = Window.partitionBy("seed").orderBy("type", "other", F.desc("forward"))
    return found.withColumn("rank", F.row_number().over(own).cast("long")).where(F.col("rank") <= limit)


def neighbourhood(nodes: DataFrame, edges: DataFrame, centre: int, node_type: str | None = None, edge_type: str | None = None) -> DataFrame:
    """(index, name, type, from_types, to_types): the centre and its neighbours, with their edges to and from the centre.

    node_type keeps candidates of that type, edge_type those that an edge of that type joins to the centre.
    """
    near = undirected(edges).where(F.col("a") == centre) if isinstance(edges, DataFrame) else edges.starting_at([centre])
    if edge_type is not None:
        near = near.where(F.col("type") == edge_type)
    lists = near.groupBy(F.col("b").alias("index")).agg(
        F.array_sort(F.collect_list(F.when(~F.col("forward"), F.col("type")))).alias("from_types"),
        F.array_sort(F.collect_list(F.when(F.col("forward"), F.col("type")))).alias("to_types"),
    )
    if edge_type is None:
        empty = F.expr("cast(array() as array<string>)")
        lists = lists.where(F.col("index") != centre).union(nodes.where(F.col("index") == centre).select("index", empty, empty))
    out = nodes.select("index", "name", "type").join(lists, "index")
    return out if node_type is None else out.where(F.col("type") == node_type)


def seeded_sample(nodes: DataFrame, edges: DataFrame, answers: DataFrame, most: int, share: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Nodes (index) and induced edges around `answers` (index): answers and neighbours, or a bounded sample of both.

    With over `most` nodes, `share` of them are answers and the rest neighbours of those, chosen by a hash of the index.
    """
    answers = answers.select("index").distinct()
    all_ = within_hops(edges, answers, 1).select("index")
    if all_.count() > most:
        order = (F.md5(F.col("index").cast("string")), F.col("index"))
        kept = answers.orderBy(*order).limit(int(most * share))
        rest = neighbours(edges, kept).select("index").distinct().join(kept, "index", "left_anti")
        all_ = kept.union(rest.orderBy(*order).limit(most - int(most * share)))
    chosen = nodes.join(all_, "index", "left_semi").select("index")
    return chosen, subgraph_edges(edges, chosen, boundary=False)
