"""Queries of composed retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import fusion as U
from graphloom.operators import retrieve as R
from graphloom.operators import search as S
from graphloom.plans.base import query, table
from graphloom.plans.graph import MEMBERS_SQL, _members
from graphloom.plans.text import _bm25_sql
from graphloom.sources import star
from graphloom.sources.star import EDGES_SQL, NODES_SQL, SCALE

HITS_SQL = "hits(query, index, score) as (values (1, 4000000000000001, 0.9), (1, 4000000000000002, 0.8), (2, 4000000000000007, 0.7))"


def _hits(spark):
    return spark.createDataFrame([(1, 4 * SCALE + 1, 0.9), (1, 4 * SCALE + 2, 0.8), (2, 4 * SCALE + 7, 0.7)], "query int, index long, score double")


ASKED = [(1, "Supplier of nation 3"), (2, "economy anodized brand Brand#11"), (3, "zzz")]
ASKED_SQL = "select * from (values (1, 'Supplier of nation 3'), (2, 'economy anodized brand Brand#11'), (3, 'zzz')) as t(query, text)"


@query("local_search", f"""with {MEMBERS_SQL}, hits as (select query, doc as index, s as score from (select query, doc, s, row_number() over (partition by query order by s desc, doc) as rank from (with {_bm25_sql('nodes', 'index', 'summary', 1.2, False, ASKED_SQL)} select query, doc, round(score, 6) as s from sc) where s > 0) where rank <= 5),
both_ends as (select start_node_index as a, end_node_index as b, type, true as forward from edges union all select end_node_index, start_node_index, type, false from edges),
x as (select a as seed, type, b as other, forward, row_number() over (partition by a order by type, b, forward desc) as rank from both_ends where a in (select index from hits)),
t as (select distinct query, case when forward then seed else other end as source, type, case when forward then other else seed end as target from hits join x on index = seed where rank <= 15),
u as (select *, row_number() over (partition by query, type, least(source, target), greatest(source, target) order by source, target) as n from t),
l as (select query, count(*) as triplets, string_agg(source || ' -[' || type || ']-> ' || target, chr(10) order by source || ' -[' || type || ']-> ' || target) as lines from u where n = 1 group by query),
e as (select query, count(*) as entities, string_agg(name || ' (' || type || ')', chr(10) order by score desc, index) as names from hits join nodes using (index) group by query),
c as (select community, cast(count(*) as double) as importance from members group by community), cx as (select distinct query, community, importance from hits join members using (index) join c using (community)),
cl as (select query, count(*) as communities, string_agg('[C' || rank || '] ' || community, chr(10) order by rank) as named from (select *, row_number() over (partition by query order by importance desc, community) as rank from cx) where rank <= 3 group by query)
select query, entities, coalesce(triplets, 0) as triplets, coalesce(communities, 0) as communities, 'Matched Entities:' || chr(10) || names || chr(10) || 'Relationships:' || chr(10) || coalesce(lines, '') || chr(10) || 'Communities:' || chr(10) || coalesce(named, '') as context from e left join l using (query) left join cl using (query)""")
def local_search(spark, d):
    members = _members(spark, d)[0]
    sizes = members.groupBy("community").agg(F.count("*").cast("double").alias("importance"))
    asked = spark.createDataFrame(ASKED, "query int, text string")
    return R.search_locally(asked, star.nodes(spark, d), star.OpenLinks(spark, d), members, sizes)


@query("contains_search", f"with {NODES_SQL} select name as id, summary as description, cast(1 as double) as score from nodes where type = 'customer' and (contains(name, 'BUILD') or contains(summary, 'Build') or contains(summary, 'BUILD')) order by name limit 20")
def contains_search(spark, d):
    rows = star.nodes(spark, d).where("type = 'customer'").select(F.col("name").alias("id"), F.col("summary").alias("description"))
    return R.contains_search(rows, "BUILD", 20)


@query("community_context", f"with {MEMBERS_SQL}, {HITS_SQL}, c as (select community, cast(count(*) as double) as importance from members group by community), x as (select distinct query, community, importance from hits join members using (index) join c using (community)) select query, cast(community as bigint) as community, importance, rank from (select *, row_number() over (partition by query order by importance desc, community) as rank from x) where rank <= 3")
def community_context(spark, d):
    members = _members(spark, d)[0]
    sizes = members.groupBy("community").agg(F.count("*").cast("double").alias("importance"))
    return R.community_context(_hits(spark), members, sizes).select("query", "community", "importance", "rank")


TOK = r"regexp_extract_all(lower({}), '([\p{{L}}\p{{N}}_]+)', 1)"
GLOBAL_SQL = f"""cs as (select p_brand as community, cast(count(*) as double) as importance, p_brand || ' of ' || string_agg(distinct p_type, ' ' order by p_type) as summary from part group by p_brand), qs(query, text) as (values (1, 'which brand has STANDARD type'), (2, 'economy of Brand#11')),
g as (select query, community, importance, summary, round(100 * len(list_intersect(list_distinct({TOK.format('text')}), {TOK.format('summary')})) / cast(len(list_distinct({TOK.format('text')})) as double), 6) as score from qs, cs),
k as (select *, row_number() over (partition by query order by importance desc, community) as n from g where score > 0)"""


@query("global_search", f"with {GLOBAL_SQL} select query, count(*) as n, string_agg('[' || printf('%.1f', score) || '] ' || summary, chr(10) order by score desc, community) as answer from k where n <= 10 group by query")
def global_search(spark, d):
    communities = table(spark, d, "part").groupBy(F.col("p_brand")).agg(F.count("*").cast("double").alias("importance"), F.array_join(F.array_sort(F.collect_set("p_type")), " ").alias("types"))
    communities = communities.select(F.col("p_brand").alias("community"), "importance", F.concat("p_brand", F.lit(" of "), "types").alias("summary"))
    asked = spark.createDataFrame([(1, "which brand has STANDARD type"), (2, "economy of Brand#11")], "query int, text string")
    return R.global_search(asked, communities)


@query("category_rescore", f"""with {_bm25_sql('documents', 'doc_id', 'text', 1.2, False)}, h as (select query, doc, round(score, 6) as score, lang = 'en' as matches, quality = 1 as semantic, n_chars % 10 / 10.0 as similarity, toxic / 2.0 as confidence from sc join documents on doc = documents.doc_id join labels on doc = labels.doc_id),
n as (select query, doc, round(score * (case when matches then 1.5 else 0.7 * 1.5 end) * (case when semantic then 1 + 0.3 * similarity else 1.0 end) * (1 + 0.2 * confidence), 6) as new_score from h)
select query, doc, cast(new_score as double) as new_score, rank from (select *, row_number() over (partition by query order by new_score desc, doc) as rank from n where new_score > 0) where rank <= 5""")
def category_rescore(spark, d):
    docs = table(spark, d, "documents")
    known = docs.join(table(spark, d, "labels"), "doc_id").select(F.col("doc_id").alias("doc"), (F.col("lang") == "en").alias("matches"), (F.col("quality") == 1).alias("semantic"), (F.col("n_chars") % 10 / 10).alias("similarity"), (F.col("toxic") / 2).alias("confidence"))
    scored = S.bm25(docs, table(spark, d, "benchmark"), "doc_id", "text", "item_id", "text", beside=known).withColumn("score", F.round("score", 6))
    return S.top_per_query(U.rescored(scored), 5, score="new_score").select("query", "doc", "new_score", "rank")


@query("rerank_dedup", """with r as (select lang, doc_id, text, n_chars, row_number() over (partition by lang, trim(text) order by doc_id) as n from documents) select lang, doc_id, new_score, rank from (select lang, doc_id, round(1 - n_chars / 40000.0, 6) as new_score, row_number() over (partition by lang order by round(1 - n_chars / 40000.0, 6) desc, doc_id) as rank from r where n = 1) where rank <= 10""")
def rerank_dedup(spark, d):
    found = U.reranked(table(spark, d, "documents"), F.round(1 - F.col("n_chars") / 40000.0, 6), "lang", "text", "doc_id", 10)
    return found.select("lang", "doc_id", "new_score", "rank")


@query("rank_score", "select lang, doc_id, round(1 - (pos - 1) / cast(n as double), 6) as score from (select lang, doc_id, row_number() over (partition by lang order by doc_id) as pos, count(*) over (partition by lang) as n from documents)")
def rank_score(spark, d):
    from pyspark.sql import Window

    own = Window.partitionBy("lang")
    rows = table(spark, d, "documents").select("lang", "doc_id", F.row_number().over(own.orderBy("doc_id")).alias("pos"), F.count("*").over(own).alias("n"))
    return rows.select("lang", "doc_id", F.round(1 - (F.col("pos") - 1) / F.col("n"), 6).alias("score"))


@query("grouped_context", f"""with {_bm25_sql('documents', 'doc_id', 'text', 1.2, False)}, hx as (select query, doc from (select query, doc, row_number() over (partition by query order by round(score, 6) desc, doc) as rank from sc where round(score, 6) > 0) where rank <= 10),
gx as (select query, lang, string_agg(text, chr(10) order by doc_id) as part from hx join documents on doc = doc_id group by query, lang), px as (select query, count(*) as n, string_agg('## ' || lang || chr(10) || part, chr(10) || chr(10) order by lang) as headed, min(part) as one from gx group by query) select query, md5(case when n > 1 then headed else one end) as digest from px""")
def grouped_context(spark, d):
    docs = table(spark, d, "documents")
    hits = S.bm25_top(docs, table(spark, d, "benchmark"), "doc_id", "text", "item_id", "text", 10).select("query", F.col("doc").alias("doc_id"))
    rows = docs.select("doc_id", "lang", "text").join(hits, "doc_id")
    return R.grouped_context(rows, "query", "lang", "text", "doc_id").select("query", F.md5("context").alias("digest"))


@query("adaptive_retrieval")
def adaptive_retrieval(spark, d):
    docs = table(spark, d, "documents")

    def search(asked):
        return S.bm25_top(docs, asked, "doc_id", "text", "query", "text", 5).select("query", "doc", "rank")

    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query"), "text")
    shorter = lambda t: F.array_join(F.slice(F.split(t, " "), 1, 5), " ")
    return R.adaptive(asked, search, docs.select(F.col("doc_id").alias("doc"), F.col("text").alias("body")), shorter, relevant_from=0.9)


@query("search_mode", r"select conv_id, turn, case when regexp_matches(lower(text), '\b(overall|themes?|summar\w+|trends?|in general)\b') then 'global' when regexp_matches(lower(text), '\b(connect\w*|path|through|relat\w+ between|via)\b') then 'agent' else 'local' end as mode from conversations")
def search_mode(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", R.search_mode(F.col("text")).alias("mode"))


@query("query_category", r"select doc_id, case when regexp_matches(text, '(?i)\b(licen[sc]ed?|copyright|rights)\b') then 'legal' when regexp_matches(text, '(?i)\b(the|and|of)\b') then 'english' else 'general' end as category from documents")
def query_category(spark, d):
    rules = {"legal": ["licen[sc]ed?", "copyright", "rights"], "english": ["the", "and", "of"]}
    return table(spark, d, "documents").select("doc_id", R.category_of(F.col("text"), rules).alias("category"))


@query("citations", f"""with {_bm25_sql('documents', 'doc_id', 'text', 1.2, False)}, t as (select *, row_number() over (partition by query order by s desc, doc) as rank from (select query, doc, round(score, 6) as s from sc) where s > 0)
select query, '[' || string_agg('{{"filename":"' || source || '","chunk_id":' || doc || ',"chunk_method":"standard","category":"' || lang || '","score":' || s || '}}', ',' order by rank) || ']' as sources from t join documents on doc = doc_id where rank <= 3 group by query""")
def citations(spark, d):
    docs = table(spark, d, "documents")
    top = S.bm25_top(docs, table(spark, d, "benchmark"), "doc_id", "text", "item_id", "text", 3)
    rows = top.join(docs.select(F.col("doc_id").alias("doc"), F.col("source").alias("filename"), F.col("lang").alias("category")), "doc")
    return R.citations(rows.select("query", "rank", "filename", F.col("doc").alias("chunk_id"), F.lit("standard").alias("chunk_method"), "category", "score"))


@query("early_stop", "with g as (select user_id, event_id, ts, sum(cast(event_type = 'click' as bigint)) over (partition by user_id order by ts, event_id) as seen, event_type from events) select user_id, event_id from g where event_type = 'click' and seen <= 2")
def early_stop(spark, d):
    from pyspark.sql import Window

    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, d, "events").withColumn("seen", F.sum((F.col("event_type") == "click").cast("long")).over(own))
    return rows.where("event_type = 'click' and seen <= 2").select("user_id", "event_id")


@query("preview_with_total", "select doc_id, lang, total from (select doc_id, lang, count(*) over (partition by lang) as total, row_number() over (partition by lang order by doc_id) as n from documents) where n <= 20")
def preview_with_total(spark, d):
    from pyspark.sql import Window

    docs = table(spark, d, "documents").select("doc_id", "lang")
    totals = docs.groupBy("lang").agg(F.count("*").alias("total"))
    top = docs.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("doc_id"))).where("n <= 20")
    return top.join(totals, "lang").select("doc_id", "lang", "total")
