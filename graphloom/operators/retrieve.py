"""Composed retrieval: local and global graph search, category-aware and adaptive retrieval.

Steps that a model would do take a function that gives a column; the ones here are plain rules, so results can be checked.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.components import ensure_checkpoints
from graphloom.operators.sizes import fits, sent_if
from graphloom.operators.traverse import expand, one_per_triplet

Grader = Callable[[Column, Column], Column]


def overlap(query: Column, text: Column) -> Column:
    """A stand-in for a relevance model: the share of the query's distinct words that a text holds."""
    from graphloom.functions.text import tokens

    asked = F.array_distinct(tokens(query))
    return F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, tokens(text))) / F.size(asked)).otherwise(0.0)


def contains_search(entities: DataFrame, query: str, k: int) -> DataFrame:
    """(id, description, score): entities whose id holds the query in upper case or whose description holds it, by id."""
    hit = F.contains("id", F.lit(query.upper())) | F.contains("description", F.lit(query))
    return entities.where(hit).orderBy("id").limit(k).select("id", "description", F.lit(1.0).alias("score"))


def local_search(hits: DataFrame, edges: DataFrame, nodes: DataFrame, per_seed: int = 15) -> DataFrame:
    """(query, entities, triplets, context) for hits (query, index, score): the matched entities, their edges once, and a prompt."""
    found = expand(edges, hits.select("index"), per_seed)
    sided = found.select("seed", F.when(F.col("forward"), F.col("seed")).otherwise(F.col("other")).alias("source"), "type", F.when(F.col("forward"), F.col("other")).otherwise(F.col("seed")).alias("target"))
    pairs = hits.select("query", F.col("index").alias("seed")).join(sided, "seed").select("query", "source", "type", "target")
    once = pairs.select(F.col("query"), F.concat_ws("/", F.col("query").cast("string"), "type").alias("_qt"), "source", "type", "target")
    once = one_per_triplet(once.withColumnsRenamed({"type": "_type", "_qt": "type"}), [F.col("source"), F.col("target")]).select("query", "source", F.col("_type").alias("type"), "target")
    line = F.concat(F.col("source").cast("string"), F.lit(" -["), "type", F.lit("]-> "), F.col("target").cast("string"))
    links = once.groupBy("query").agg(F.count("*").alias("triplets"), F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("lines"))
    named = hits.join(nodes.select("index", "name", "type"), "index")
    top = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "index", F.concat("name", F.lit(" ("), "type", F.lit(")")).alias("t")))), lambda x: x["t"])
    entities = named.groupBy("query").agg(F.count("*").alias("entities"), F.array_join(top, "\n").alias("names"))
    out = entities.join(links, "query", "left")
    return out.select("query", "entities", F.coalesce("triplets", F.lit(0)).alias("triplets"), F.concat(F.lit("Matched Entities:\n"), "names", F.lit("\nRelationships:\n"), F.coalesce("lines", F.lit(""))).alias("context"))


def multi_query(queries: DataFrame, id_col: str, text_col: str, rewrites: Sequence[Callable[[Column], Column]], search: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(query, item, rank, variant): what a query and its rewritten variants find, each item once, with its best rank.

    search: from (query, text), where the query is a number with one digit more for the variant, to (query, doc, rank).
    Of equal ranks the earlier variant counts, the query itself before all; at most nine variants.
    """
    texts = F.array(F.col(text_col), *(rewrite(F.col(text_col)) for rewrite in rewrites))
    asked = queries.select(F.col(id_col), F.posexplode(texts).alias("_v", "text")).select((F.col(id_col) * 10 + F.col("_v")).cast("long").alias("query"), "text")
    found = search(asked).select(F.floor(F.col("query") / 10).alias("query"), F.col("doc").alias("item"), F.struct("rank", (F.col("query") % 10).alias("variant")).alias("at"))
    return found.groupBy("query", "item").agg(F.min("at").alias("at")).select("query", "item", "at.rank", "at.variant")


def search_locally(queries: DataFrame, nodes: DataFrame, edges: DataFrame, members: DataFrame, communities: DataFrame, k: int = 5, per_seed: int = 15, allowed: Column | None = None) -> DataFrame:
    """(query, entities, triplets, communities, context) from (query, text): entities by BM25, their edges, their communities.

    allowed: a condition on nodes that entities must meet; it is checked after the best `k` were found. Queries that find
    no entity have no row.
    """
    from graphloom.operators.search import bm25_top

    ensure_checkpoints(nodes.sparkSession)
    texts = nodes.select("index", F.col("summary").alias("text"))
    hits = bm25_top(texts, queries, "index", "text", "query", "text", k).select("query", F.col("doc").alias("index"), "score").checkpoint()  # four joins start from it
    hits = sent_if(fits(hits), hits)
    if allowed is not None:
        hits = nodes.where(allowed).select("index").distinct().join(hits, "index").select("query", "index", "score")
    near = community_context(hits, members, communities).withColumn("line", F.concat(F.lit("[C"), F.col("rank").cast("string"), F.lit("] "), F.col("community").cast("string")))
    listed = near.groupBy("query").agg(F.count("*").alias("communities"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n").alias("named"))
    out = local_search(hits, edges, nodes, per_seed).join(listed, "query", "left")
    return out.select("query", "entities", "triplets", F.coalesce("communities", F.lit(0)).alias("communities"), F.concat("context", F.lit("\nCommunities:\n"), F.coalesce("named", F.lit(""))).alias("context"))


def community_context(hits: DataFrame, members: DataFrame, communities: DataFrame, k: int = 3) -> DataFrame:
    """(query, community, importance, rank): the most important communities of each query's entities."""
    found = hits.select("query", "index").join(members, "index").select("query", "community").distinct().join(communities, "community")
    own = Window.partitionBy("query").orderBy(F.desc("importance"), "community")
    return found.withColumn("rank", F.row_number().over(own).cast("long")).where(F.col("rank") <= k)


def global_search(queries: DataFrame, communities: DataFrame, most: int = 10, least: float = 0.0, grade: Grader = overlap) -> DataFrame:
    """(query, n, answer) of queries (query, text) over community texts (community, importance, summary).

    Communities that share a word with the query are graded by importance until `most` are relevant; each gives a scored
    partial answer; answers by score are put together.
    """
    from graphloom.functions.text import tokens

    asked = queries.select("query", "text", F.explode_outer(F.array_distinct(tokens(F.col("text")))).alias("word"))
    held = communities.select("community", F.explode_outer(F.array_distinct(tokens(F.col("summary")))).alias("word"))
    pairs = asked.join(held, "word").select("query", "text", "community").distinct()
    rows = pairs.join(communities, "community").withColumn("score", F.round(100 * grade(F.col("text"), F.col("summary")), 6))
    relevant = rows.where(F.col("score") > least)
    own = Window.partitionBy("query").orderBy(F.desc("importance"), "community")
    kept = relevant.withColumn("n", F.row_number().over(own)).where(F.col("n") <= most)
    parts = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "community", F.concat(F.lit("["), F.format_number("score", 1), F.lit("] "), "summary").alias("t"))))
    return kept.groupBy("query").agg(F.count("*").alias("n"), F.array_join(F.transform(parts, lambda x: x["t"]), "\n").alias("answer"))


def grouped_context(rows: DataFrame, query: str, category: str, text: str, order: str) -> DataFrame:
    """(query, context): texts in order, under a heading for each category if there are several."""
    inner = rows.groupBy(query, category).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), "\n").alias("part"))
    parts = inner.groupBy(query).agg(F.array_sort(F.collect_list(F.struct(category, "part"))).alias("p"))
    headed = F.array_join(F.transform("p", lambda x: F.concat(F.lit("## "), x[category], F.lit("\n"), x["part"])), "\n\n")
    return parts.select(query, F.when(F.size("p") > 1, headed).otherwise(F.col("p")[0]["part"]).alias("context"))


def adaptive(queries: DataFrame, search: Callable[[DataFrame], DataFrame], docs: DataFrame, rewrite: Callable[[Column], Column], k: int = 5, theta: float = 0.5, retries: int = 2, grade: Grader = overlap, relevant_from: float = 0.5) -> DataFrame:
    """(query, doc, relevant, attempt): retrieval that is repeated with a rewritten query where too few results are relevant.

    search: from (query, text) to (query, doc, rank). Queries whose share of relevant results reaches `theta` are done. The
    last attempt's relevant results are kept, or all of them if none is. Each attempt's search runs once: what it found, how that
    was graded and the queries that wait are cut off by checkpoint(), and few results go to the documents.
    """
    ensure_checkpoints(queries.sparkSession)
    waiting, done = queries.select("query", "text"), None
    for attempt in range(retries + 1):
        found = search(waiting).where(F.col("rank") <= k).select("query", "doc").checkpoint()
        hits = docs.join(sent_if(fits(found), found), "doc").join(waiting, "query")
        graded = hits.select("query", "doc", (grade(F.col("text"), F.col("body")) >= relevant_from).alias("relevant"), F.lit(attempt).alias("attempt")).checkpoint()
        shares = graded.groupBy("query").agg(F.avg(F.col("relevant").cast("double")).alias("share"))
        last = attempt == retries
        settled = shares.where(F.lit(True) if last else F.col("share") >= theta)
        kept = graded.join(settled, "query").where(F.col("relevant") | (F.col("share") == 0)).select("query", "doc", "relevant", "attempt")
        done = kept if done is None else done.union(kept)
        if last:
            return done
        waiting = waiting.join(settled, "query", "left_anti").select("query", rewrite(F.col("text")).alias("text")).checkpoint()
    return done


def search_mode(query: Column) -> Column:
    """A stand-in for a classifier: words of themes ask for global search, several hops for the agent, else local."""
    text = F.lower(query)
    return F.when(text.rlike(r"\b(overall|themes?|summar\w+|trends?|in general)\b"), "global").when(text.rlike(r"\b(connect\w*|path|through|relat\w+ between|via)\b"), "agent").otherwise("local")


def category_of(text: Column, rules: dict[str, list[str]], fallback: str = "general") -> Column:
    """The first category any of whose words a text holds."""
    out = F.lit(fallback)
    for name, words in reversed(list(rules.items())):
        out = F.when(text.rlike(r"(?i)\b(" + "|".join(words) + r")\b"), name).otherwise(out)
    return out


def citations(hits: DataFrame, query: str = "query") -> DataFrame:
    """(query, sources): a JSON list of file name, chunk, method, category and score of each query's hits by rank."""
    item = F.struct("rank", F.struct("filename", "chunk_id", "chunk_method", "category", "score").alias("source"))
    return hits.groupBy(query).agg(F.to_json(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["source"])).alias("sources"))
