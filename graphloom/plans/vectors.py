"""Queries of vector search and rank fusion. Query vectors are the rows whose id is divisible by 50."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from graphloom.functions.records import norm
from graphloom.operators import components as C
from graphloom.operators import fusion as U
from graphloom.operators import nearest as N
from graphloom.operators import retrieve as R
from graphloom.operators import search as S
from graphloom.plans.base import query, table
from graphloom.plans.text import _bm25_sql


def _tables(spark, d):
    vectors = table(spark, d, "embeddings")
    return vectors, vectors.where("vec_id % 50 = 0")


VEC_SQL = """e as (select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings),
s as (select q.vec_id as query, q.label as query_label, e.vec_id as item, e.label, round(list_dot_product(q.v, e.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(e.v, e.v))), 6) as score from e q, e where q.vec_id % 50 = 0)"""
RANKED = "select query, item, score, row_number() over (partition by query order by score desc, item) as rank"


@query("vector_norms", "select vec_id, round(sqrt(list_dot_product(list_transform(embedding, lambda x: cast(x as double)), list_transform(embedding, lambda x: cast(x as double)))), 6) as norm from embeddings")
def vector_norms(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(norm(F.col("embedding")), 6).alias("norm"))


@query("vector_topk", f"with {VEC_SQL} select * from ({RANKED} from s) where rank <= 10")
def vector_topk(spark, d):
    return N.nearest(*_tables(spark, d), 10)


@query("vector_topk_subset", f"with {VEC_SQL} select * from ({RANKED} from s where label in (1, 2)) where rank <= 10")
def vector_topk_subset(spark, d):
    vectors, queries = _tables(spark, d)
    return N.nearest(vectors.where("label in (1, 2)"), queries, 10)


@query("vector_acl_postfilter", f"with {VEC_SQL} select query, item, score, rank from ({RANKED}, label from s) where rank <= 10 and label % 2 = 0")
def vector_acl_postfilter(spark, d):
    return N.nearest_allowed(*_tables(spark, d), 10, F.col("label") % 2 == 0)


@query("vector_acl_prefilter", f"with {VEC_SQL} select * from ({RANKED} from s where label % 2 = 0) where rank <= 10")
def vector_acl_prefilter(spark, d):
    return N.nearest_allowed(*_tables(spark, d), 10, F.col("label") % 2 == 0, prefilter=True)


@query("vector_overfetch", f"with {VEC_SQL} select query, item, score, rank from ({RANKED} from s) where rank <= 5")
def vector_overfetch(spark, d):
    return N.nearest(*_tables(spark, d), max(3 * 5, 15)).where("rank <= 5")


@query("vector_cells")
def vector_cells(spark, d):
    """How many vectors beside itself an index of cells finds for each query, and how many of them are among the exact best ten."""
    vectors, queries = _tables(spark, d)
    C.ensure_checkpoints(spark)
    index = N.CellIndex.build(vectors, f"{spark.sparkContext.getCheckpointDir()}/cells-{uuid.uuid4().hex}")
    found = index.search(queries, 11).where("query <> item")
    exact = N.nearest(vectors, queries, 11).where("query <> item").select("query", "item", F.lit(1).alias("hit"))
    return found.join(exact, ["query", "item"], "left").groupBy("query").agg(F.count("*").alias("found"), F.count("hit").alias("hits"))


@query("vector_bucketed")
def vector_bucketed(spark, d):
    return N.bucketed(*_tables(spark, d), 10)


@query("community_vectors", f"""with m as (select label as community, 0 as level, min(vec_id) as vec_id from embeddings group by label union all select 100 + label % 3, 1, min(vec_id) from embeddings group by label % 3),
c as (select m.community, level, list_transform(embedding, lambda x: cast(x as double)) as v from m join embeddings using (vec_id)), q as (select vec_id as query, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings where vec_id % 50 = 0),
s as (select query, cast(community as bigint) as community, level, round(list_dot_product(q.v, c.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(c.v, c.v))), 6) as score from q, c)
select query, community, score, rank from (select *, row_number() over (partition by query order by score desc, community) as rank from s) where rank <= 5 and level = 0""")
def community_vectors(spark, d):
    vectors, queries = _tables(spark, d)
    first = lambda key, level: vectors.groupBy(key.cast("long").alias("community")).agg(F.min_by("embedding", "vec_id").alias("embedding")).select("community", F.lit(level).alias("level"), "embedding")
    communities = first(F.col("label"), 0).union(first(100 + F.col("label") % 3, 1))
    return N.nearest_communities(communities, queries, 5, level=0)


def _lists(spark, d):
    """Two ranked lists of ten documents for each benchmark item: by BM25 of its text, and by the vector of its id.

    A document's vector is the embedding of its id; documents without one are found by their text only.
    """
    docs, items, vectors = table(spark, d, "documents"), table(spark, d, "benchmark"), table(spark, d, "embeddings")
    sparse = S.bm25_top(docs, items, "doc_id", "text", "item_id", "text", 10)
    own = vectors.join(docs.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    asked = vectors.join(items.select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi")
    dense = N.nearest(own, asked, 10)
    return sparse.select("query", F.col("doc").alias("item"), "rank"), dense.select("query", "item", "rank")


def _top_sql(limit: int = 10) -> str:
    return f"select query, doc as item, rank from (select query, doc, row_number() over (partition by query order by s desc, doc) as rank from (select query, doc, round(score, 6) as s from sc) where s > 0) where rank <= {limit}"


def _lists_sql() -> str:
    cosine = "round(list_dot_product(q.v, e.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(e.v, e.v))), 6)"
    return f"""sparse as (with {_bm25_sql('documents', 'doc_id', 'text', 1.2, False)} {_top_sql()}),
ev as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings where embedding is not null),
dense as (select query, item, rank from (select query, item, row_number() over (partition by query order by score desc, item) as rank from (select q.vec_id as query, e.vec_id as item, {cosine} as score from ev q, ev e where q.vec_id in (select item_id from benchmark) and e.vec_id in (select doc_id from documents))) where rank <= 10)"""


def _fused_sql(a: float, b: float) -> str:
    return f"""with {_lists_sql()}, f as (select query, item, round(sum(w / (60 + rank)), 6) as score from (select *, cast({a} as double) as w from sparse union all select *, cast({b} as double) from dense) group by query, item)
select query, item, score, row_number() over (partition by query order by score desc, item) as rank from f"""


@query("hybrid_rrf", _fused_sql(0.3, 0.7))
def hybrid_rrf(spark, d):
    sparse, dense = _lists(spark, d)
    return U.weighted_ranks(sparse.withColumn("weight", F.lit(0.3)).union(dense.withColumn("weight", F.lit(0.7))))


@query("ensemble_rrf", _fused_sql(0.5, 0.5))
def ensemble_rrf(spark, d):
    sparse, dense = _lists(spark, d)
    return U.weighted_ranks(sparse.union(dense).withColumn("weight", F.lit(0.5)))


VARIANTS_SQL = "select item_id * 10 + v as query, case v when 0 then text when 1 then array_to_string(string_split(text, ' ')[1:5], ' ') else array_to_string(string_split(text, ' ')[6:], ' ') end as text from benchmark, (values (0), (1), (2)) as t(v)"


@query("multi_query_union", f"with l as (with {_bm25_sql('documents', 'doc_id', 'text', 1.2, False, VARIANTS_SQL)} {_top_sql(5)}) select cast(query // 10 as bigint) as query, item, min(rank * 10 + query % 10) // 10 as rank, min(rank * 10 + query % 10) % 10 as variant from l group by query // 10, item")
def multi_query_union(spark, d):
    docs, items = table(spark, d, "documents"), table(spark, d, "benchmark")
    words = F.split("text", " ")
    parts = (lambda t: F.array_join(F.slice(words, 1, 5), " "), lambda t: F.array_join(F.slice(words, 6, 1 << 30), " "))
    return R.multi_query(items, "item_id", "text", parts, lambda asked: S.bm25_top(docs, asked, "doc_id", "text", "query", "text", 5))


VOTES_SQL = """v as (select question, agent, node, row_number() over (partition by question, agent order by ts, event_id) as pos from (select *, strftime(ts, '%Y-%m-%d') as question, user_id % 3 as agent, cast(json_extract_string(props, '$.k') as bigint) as node from events)),
f as (select *, row_number() over (partition by question order by agent, pos) as flat from v)"""


def _votes(spark, d):
    from pyspark.sql import Window

    events = table(spark, d, "events").select("ts", "event_id", F.date_format("ts", "yyyy-MM-dd").alias("question"), (F.col("user_id") % 3).alias("agent"), F.get_json_object("props", "$.k").cast("long").alias("node"))
    return events.select("question", "agent", "node", F.row_number().over(Window.partitionBy("question", "agent").orderBy("ts", "event_id")).cast("long").alias("pos"))


@query("votes_flat", f"with {VOTES_SQL} select question, node, count(*) as votes, min(flat) as place, row_number() over (partition by question order by count(*) desc, min(flat), node) as rank from f group by question, node")
def votes_flat(spark, d):
    return U.votes(_votes(spark, d), "flat")


@query("votes_min_depth", f"with {VOTES_SQL} select question, node, count(*) as votes, min(pos) as place, row_number() over (partition by question order by count(*) desc, min(pos), node) as rank from f group by question, node")
def votes_min_depth(spark, d):
    return U.votes(_votes(spark, d), "min_depth")


@query("votes_first_agent", f"""with {VOTES_SQL}, g as (select question, node, count(*) as votes, min(agent * 1000000 + pos) as ap from f group by question, node)
select question, node, votes, cast(ap // 1000000 as bigint) as agent, cast(ap % 1000000 as bigint) as pos, row_number() over (partition by question order by votes desc, ap, node) as rank from g""")
def votes_first_agent(spark, d):
    return U.votes(_votes(spark, d), "first_agent").select("question", "node", "votes", "place.agent", "place.pos", "rank")


@query("votes_reciprocal", f"with {VOTES_SQL}, g as (select question, node, count(distinct agent) as votes, round(sum(cast(1 as double) / (60 + pos)), 9) as place from f group by question, node) select *, row_number() over (partition by question order by place desc, node) as rank from g")
def votes_reciprocal(spark, d):
    return U.votes(_votes(spark, d), "reciprocal")
