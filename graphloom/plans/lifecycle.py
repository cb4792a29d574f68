"""Queries of merging, deletion and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom.operators import fusion as U
from graphloom.operators import merge as M
from graphloom.plans.base import placed, query, table

ARRIVALS_SQL = """arr as (select l_partkey as id, o_orderpriority as source_document, l_orderkey * 10 + l_linenumber as seq, case when l_linenumber = 1 then null else l_returnflag end as type, case when l_linenumber = 2 then '' when l_linenumber = 3 then null else l_linestatus || l_linenumber end as description from lineitem join orders on l_orderkey = o_orderkey),
ents as (select id, arg_min(type, seq) filter (type is not null) as type, arg_min(description, seq) filter (description is not null) as description, count(*) as n from arr group by id),
ed as (select id, list(source_document order by s) as docs from (select id, source_document, min(seq) as s from arr group by all) group by id)"""


def _arrivals(spark, d, how="inner"):
    n = F.col("l_linenumber")
    rows = placed(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"), how)
    return rows.select(F.col("l_partkey").alias("id"), F.col("o_orderpriority").alias("source_document"), (F.col("l_orderkey") * 10 + n).alias("seq"), F.when(n != 1, F.col("l_returnflag")).alias("type"), F.when(n == 2, "").when(n != 3, F.concat("l_linestatus", n.cast("string"))).alias("description"), F.col("l_suppkey"), "l_orderkey", n.alias("line"), "place", F.col("o_orderkey").isNotNull().alias("known"))


@query("entity_merge", f"with {ARRIVALS_SQL} select id, type, description, array_to_string(docs, ',') as docs, n from ents join ed using (id)")
def entity_merge(spark, d):
    return M.merge_entities(_arrivals(spark, d).where("id is not null"), tie="place").select("id", "type", "description", F.array_join("source_documents", ",").alias("docs"), "n")


def _relations(spark, d):
    rows = _arrivals(spark, d).select(F.col("id").alias("source"), F.lit("SUPPLIED_BY").alias("type"), F.col("l_suppkey").alias("target"), F.col("description"), "source_document", "seq")
    known = table(spark, d, "part").where("p_partkey % 10 <> 0").select(F.col("p_partkey").alias("id"))
    return M.merge_relations(rows, known)


REL_SQL = "rel as (select l_partkey as source, 'SUPPLIED_BY' as type, l_suppkey as target, o_orderpriority as d, l_orderkey * 10 + l_linenumber as seq from lineitem join orders on l_orderkey = o_orderkey), known as (select p_partkey as id from part where p_partkey % 10 <> 0)"


@query("relation_merge", f"with {REL_SQL}, dd as (select source, type, target, d, min(seq) as s from rel group by all) select source, type, target, string_agg(d, ',' order by s) as docs from dd where source in (select id from known) and target in (select id from known) group by source, type, target")
def relation_merge(spark, d):
    return _relations(spark, d)[0].select("source", "type", "target", F.array_join("source_documents", ",").alias("docs"))


@query("relation_counts", f"with {REL_SQL}, g as (select distinct source, target from rel) select count(*) as seen, count(*) filter (source in (select id from known) and target in (select id from known)) as stored from g")
def relation_counts(spark, d):
    return _relations(spark, d)[1]


CLAIM_SQL = "cl as (select 'user' || user_id as subject_id, event_type as object_id, upper(event_type) || ' at ' || strftime(ts, '%Y-%m-%d') as description, 'doc' || (event_id % 5) as d, event_id as seq from events), ck as (select *, 'CLM_' || substring(sha256(upper(subject_id) || ':' || lower(description)), 1, 16) as id from cl)"


def _claims(spark, d):
    e = table(spark, d, "events")
    rows = e.select(F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("subject_id"), F.col("event_type").alias("object_id"), F.concat(F.upper("event_type"), F.lit(" at "), F.date_format("ts", "yyyy-MM-dd")).alias("description"), F.concat(F.lit("doc"), (F.col("event_id") % 5).cast("string")).alias("source_document"), F.col("event_id").alias("seq"))
    known = e.where("user_id % 3 = 0").select(F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("id")).distinct().union(e.where("event_type = 'click'").select("event_type").distinct())
    return M.merge_claims(rows, known)


@query("claim_merge", f"with {CLAIM_SQL}, dd as (select id, d, min(seq) as s from ck group by all), l as (select id, string_agg(d, ',' order by s) as docs from dd group by id) select id, arg_min(subject_id, seq) as subject_id, arg_min(description, seq) as description, any_value(docs) as docs from ck join l using (id) group by id")
def claim_merge(spark, d):
    return _claims(spark, d)[0].select("id", "subject_id", "description", F.array_join("source_documents", ",").alias("docs"))


@query("claim_links", f"with {CLAIM_SQL}, k as (select distinct 'user' || user_id as id from events where user_id % 3 = 0 union select 'click'), c as (select distinct id, subject_id, object_id from ck) select subject_id as entity, id as claim, 'HAS_CLAIM' as kind from c where subject_id in (select id from k) union all select object_id, id, 'REFERENCES' from c where object_id in (select id from k)")
def claim_links(spark, d):
    return _claims(spark, d)[1]


@query("delete_document", f"with {ARRIVALS_SQL}, x as (select id, list_filter(docs, lambda v: v <> '1-URGENT' and v <> '2-HIGH') as docs from ed) select id, array_to_string(docs, ',') as docs from x where len(docs) > 0")
def delete_document(spark, d):
    rows = M.merge_entities(_arrivals(spark, d))
    for document in ("1-URGENT", "2-HIGH"):
        rows = M.without_document(rows, document)
    return rows.select("id", F.array_join("source_documents", ",").alias("docs"))


@query("delete_by_file", "select o_orderkey, o_orderpriority from orders where o_orderpriority <> '5-LOW'")
def delete_by_file(spark, d):
    return table(spark, d, "orders").where("o_orderpriority <> '5-LOW'").select("o_orderkey", "o_orderpriority")


@query("gleaned", "with a as (select distinct upper(trim(p_name)) as k from part where p_size % 2 = 0), b as (select lower(p_name) as name, upper(p_name) as k from part where p_size % 3 = 0), n as (select min(name) as name, k from b where k not in (select k from a) group by k) select name from (select distinct p_name as name from part where p_size % 2 = 0) union all select name from n")
def gleaned(spark, d):
    parts = table(spark, d, "part")
    first = parts.where("p_size % 2 = 0").select(F.col("p_name").alias("name")).distinct()
    rounds = [parts.where("p_size % 3 = 0").select(F.lower("p_name").alias("name"))]
    return M.glean(first, lambda k: rounds[k] if k < len(rounds) else None, ["name"])


@query("status_latest", "with c as (select user_id, event_type as status, ts, event_id, case when event_type = 'view' then 0 else cast(json_extract_string(props, '$.k') as bigint) end as n from events) select user_id, arg_max(status, (ts, event_id)) as status, coalesce(arg_max(n, (ts, event_id)) filter (n > 0), 0) as entity_count from c group by user_id")
def status_latest(spark, d):
    n = F.when(F.col("event_type") == "view", 0).otherwise(F.get_json_object("props", "$.k").cast("long"))
    return M.latest_status(table(spark, d, "events").select("user_id", F.col("event_type").alias("status"), "ts", "event_id", n.alias("entity_count")), "user_id", ["ts", "event_id"])


@query("catalog_newest", "select event_id, strftime(e.ts, '%Y-%m-%d %H:%M:%S') as ts from events e")
def catalog_newest(spark, d):
    return table(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))


@query("anti_join_pending", "select doc_id from documents where doc_id not in (select vec_id from embeddings)")
def anti_join_pending(spark, d):
    return M.pending(table(spark, d, "documents").select("doc_id"), table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id")


@query("dedup_content", "select doc_id from (select doc_id, row_number() over (partition by trim(text) order by doc_id) as n from documents) where n = 1")
def dedup_content(spark, d):
    return U.first_of_each_text(table(spark, d, "documents"), "text", "doc_id").select("doc_id")


@query("keep_last", "select user_id, event_id from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events) where n = 1")
def keep_last(spark, d):
    return U.last_of_each(table(spark, d, "events"), "user_id", ["ts", "event_id"]).select("user_id", "event_id")


@query("set_ops", "with a as (select distinct o_custkey as k from orders where o_orderpriority = '1-URGENT'), b as (select distinct o_custkey as k from orders where o_orderpriority = '5-LOW') select 'both' as part, count(*) as n from (select k from a intersect select k from b) union all select 'either', count(*) from (select k from a union select k from b) union all select 'first', count(*) from (select k from a except select k from b) union all select 'all', count(*) from (select k from a union all select k from b)")
def set_ops(spark, d):
    orders = table(spark, d, "orders")
    a, b = (orders.where(F.col("o_orderpriority") == p).select("o_custkey").distinct() for p in ("1-URGENT", "5-LOW"))
    out = None
    for part, df in (("both", a.intersect(b)), ("either", a.union(b).distinct()), ("first", a.subtract(b)), ("all", a.union(b))):
        row = df.agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), "n")
        out = row if out is None else out.union(row)
    return out


@query("distinct_edges", "select distinct o_custkey, o_orderstatus from orders")
def distinct_edges(spark, d):
    return table(spark, d, "orders").select("o_custkey", "o_orderstatus").dropDuplicates()


@query("hash_ids", "select item_id, 'CLM_' || substring(sha256('BENCH:' || lower(text)), 1, 16) as claim, 'parent_' || substring(md5(substring(text, 1, 200)), 1, 8) || '_' || item_id as parent from benchmark")
def hash_ids(spark, d):
    return table(spark, d, "benchmark").select("item_id", X.claim_id(F.lit("bench"), F.col("text")).alias("claim"), X.parent_id(F.col("text"), F.col("item_id")).alias("parent"))


@query("hash_sample", "select doc_id from documents order by md5(cast(doc_id as varchar)), doc_id limit 100")
def hash_sample(spark, d):
    return table(spark, d, "documents").select("doc_id").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(100)


@query("index_pipeline", r"""with a as (select doc_id, regexp_replace(text, '[\x{0000}\x{FEFF}\x{FFFE}\x{200B}\x{200C}\x{200D}\x{2060}]', '', 'g') as t from documents),
b as (select doc_id, trim(regexp_replace(regexp_replace(regexp_replace(replace(t, chr(9), '    '), '[\t\x0B\f\r \x1C-\x1F\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' +\n', chr(10), 'g'), chr(10) || chr(13) || chr(9) || ' ') as t from a),
n as (select (select count(*) from documents) as x, count(*) as c, cast(sum((length(t) + 799) // 800) as bigint) as k from b where t <> '')
select unnest(['extract', 'clean', 'chunk', 'insert']) as stage, unnest([x, c, k, k]) as rows from n""")
def index_pipeline(spark, d):
    from graphloom.operators.indexing import index_documents

    _, metrics = index_documents(table(spark, d, "documents"), lambda chunks: chunks.write.format("noop").mode("overwrite").save(), unicode=False)
    return spark.createDataFrame([(m["stage"], m["rows"]) for m in metrics], "stage string, rows long")


@query("reviews_cleaned", "select l_partkey, l_orderkey, l_linenumber, case when l_linenumber % 3 <> 0 then l_quantity end as rating from lineitem")
def reviews_cleaned(spark, d):
    from graphloom.operators.summaries import cleaned

    rating = F.when(F.col("l_linenumber") % 3 == 0, float("nan")).otherwise(F.col("l_quantity").cast("double"))
    lines = table(spark, d, "lineitem").select("l_partkey", F.struct("l_orderkey", "l_linenumber", rating.alias("rating")).alias("r"))
    lists = lines.groupBy("l_partkey").agg(F.collect_list("r").alias("reviews"))
    return cleaned(lists, "reviews").select("l_partkey", F.explode("reviews").alias("r")).select("l_partkey", "r.l_orderkey", "r.l_linenumber", "r.rating")


@query("detail_summaries", """select p_partkey, '- name: ' || p_name || chr(10) || '- type: ' || case when p_size % 2 = 0 then 'gene/protein' else 'drug' end || chr(10) || '- source: made' || chr(10) || '- details:' || chr(10)
|| case when p_size % 2 = 0 then '  - alias (other gene names): ' || p_brand || chr(10) || '  - interpro (protein family and classification information): ["' || p_brand || '"]' || chr(10) || '  - generif (PubMed text): a ' || p_size || '; b'
 else '  - alias: ' || p_brand || chr(10) || '  - interpro: {"desc":"' || p_brand || '"}' || chr(10) || '  - generif: [{"text":"a ' || p_size || '"},{"text":"b"}]' end as summary from part""")
def detail_summaries(spark, d):
    from graphloom.operators.summaries import described_node

    details = F.concat(F.lit('{"_id":"1","entrez_id":"2","empty":"","none":null,"alias":"'), "p_brand", F.lit('","interpro":{"desc":"'), "p_brand", F.lit('"},"generif":[{"text":"a '), F.col("p_size").cast("string"), F.lit('"},{"text":"b"}]}'))
    kind = F.when(F.col("p_size") % 2 == 0, "gene/protein").otherwise("drug")
    return table(spark, d, "part").select("p_partkey", described_node(F.col("p_name"), kind, F.lit("made"), details).alias("summary"))
