"""Queries of scalar functions, readers, and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from graphloom.functions import records as J
from graphloom.functions import text as X
from graphloom.operators import merge as M
from graphloom.operators.components import ensure_checkpoints
from graphloom.plans.base import query, table
from graphloom.plans.lifecycle import ARRIVALS_SQL, _arrivals
from graphloom.sources import files
from graphloom.streaming import ingest as S


@query("text_keys", r"""select p_partkey, upper(trim(p_name)) as entity, coalesce(nullif(regexp_replace(replace(upper(trim(p_type)), ' ', '_'), '[^A-Z0-9_]', '', 'g'), ''), 'RELATED_TO') as relation, substring(p_name, 1, 5) as short from part""")
def text_keys(spark, d):
    return table(spark, d, "part").select("p_partkey", X.entity_key(F.col("p_name")).alias("entity"), X.relation_type(F.col("p_type")).alias("relation"), X.truncated(F.col("p_name"), 5).alias("short"))


@query("page_marks", r"""with t as (select item_id, '--- Page ' || item_id || ' ---' || chr(10) || text || chr(10) || item_id || chr(10) || 'page ' || item_id || ' OF 99 end' as t from benchmark) select item_id, md5(regexp_replace(regexp_replace(regexp_replace(t, '---\s*Page\s*\d+\s*---\n?', '', 'g'), '(?m)^\s*\d{1,4}\s*$', '', 'g'), 'Page\s+\d+\s+of\s+\d+', '', 'gi')) as digest from t""")
def page_marks(spark, d):
    n = F.col("item_id").cast("string")
    text = F.concat(F.lit("--- Page "), n, F.lit(" ---\n"), "text", F.lit("\n"), n, F.lit("\npage "), n, F.lit(" OF 99 end"))
    return table(spark, d, "benchmark").select("item_id", F.md5(X.without_page_marks(text)).alias("digest"))


@query("reply_cleaning", r"""with t as (select conv_id, turn, '<think>' || role || '</think> ' || '{"a": "' || regexp_replace(text, '[^a-zA-Z ]', '', 'g') || '"} tail' as r from conversations) select conv_id, turn, trim(regexp_replace(r, '<think>.*?</think>', '', 'gs')) as plain, regexp_extract(r, '(?s)(\{.*\})', 1) as object from t""")
def reply_cleaning(spark, d):
    plain = F.regexp_replace("text", "[^a-zA-Z ]", "")
    r = F.concat(F.lit("<think>"), "role", F.lit("</think> "), F.lit('{"a": "'), plain, F.lit('"} tail'))
    return table(spark, d, "conversations").select("conv_id", "turn", X.without_thinking(r).alias("plain"), X.first_object(r).alias("object"))


@query("thinking_split", r"""select conv_id, turn, role || chr(10) || chr(10) || 'b' as reasoning, 'x  y' as rest from conversations""")
def thinking_split(spark, d):
    r = J.thinking(F.concat(F.lit("x <think>"), "role", F.lit("</think><think> </think><think>\nb</think> y")))
    return table(spark, d, "conversations").select("conv_id", "turn", r.alias("r")).select("conv_id", "turn", "r.reasoning", "r.rest")


@query("tool_call_parser", """select event_id, unnest([0, 1]) as nth, unnest([event_type, 'finish']) as name, unnest(['{"k":' || json_extract_string(props, '$.k') || '}', null]) as arguments from events""")
def tool_call_parser(spark, d):
    content = F.concat(F.lit('a <tool_call>\n{"name": "'), "event_type", F.lit('", "arguments": {"k": '), F.get_json_object("props", "$.k"), F.lit('}}\n</tool_call> b <tool_call>{"name": "finish"}</tool_call>'))
    return table(spark, d, "events").select("event_id", F.posexplode(J.tool_calls(content)).alias("nth", "c")).select("event_id", "nth", "c.name", "c.arguments")


@query("ranking_parser", """with r(i, complete, dropped) as (values (0, '2,0,1', '2,0'), (1, '1,2,0', '1,2'), (2, '0,1,2', '')) select item_id, complete, dropped from benchmark join r on item_id % 3 = i""")
def ranking_parser(spark, d):
    m = F.col("item_id") % 3
    reply = F.when(m == 0, '{"ranking": [2, 2, 9, 0]}').when(m == 1, "I rank 1 then 2 then 77").otherwise("none")
    show = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return table(spark, d, "benchmark").select("item_id", show(J.ranking(reply, F.lit(3))).alias("complete"), show(J.ranking(reply, F.lit(3), complete=False)).alias("dropped"))


@query("sub_query_parser", """with r(i, parts) as (values (0, 'a|b|c'), (1, 'd|e'), (2, 'whole')) select item_id, parts from benchmark join r on item_id % 3 = i""")
def sub_query_parser(spark, d):
    m = F.col("item_id") % 3
    reply = F.when(m == 0, '["a", "b", " c ", "d"]').when(m == 1, 'Sure: ["d", "", "e"] ok').otherwise("no list")
    return table(spark, d, "benchmark").select("item_id", F.array_join(J.sub_queries(reply, F.lit("whole")), "|").alias("parts"))


@query("findings_round_trip", """select item_id, cast(to_json([regexp_replace(text, '[^a-z]', '', 'g'), lower('B')]) as varchar) as stored, regexp_replace(text, '[^a-z]', '', 'g') || '|b' as back, 'not json' as lenient from benchmark""")
def findings_round_trip(spark, d):
    letters = F.regexp_replace("text", "[^a-z]", "")
    rows = table(spark, d, "benchmark").select("item_id", F.to_json(F.array(letters, F.lit("b"))).alias("stored"))
    return rows.select("item_id", "stored", F.array_join(J.findings(F.col("stored")), "|").alias("back"), F.array_join(J.findings(F.lit("not json")), "|").alias("lenient"))


@query("answer_nodes", "select item_id, 'n' || item_id || ',x' as ids, 'why,' as reasons from benchmark")
def answer_nodes(spark, d):
    value = F.concat(F.lit('[{"node_id": "n'), F.col("item_id").cast("string"), F.lit('", "reason": "why"}, "x"]'))
    nodes = J.answer_nodes(value)
    return table(spark, d, "benchmark").select("item_id", F.array_join(F.transform(nodes, lambda x: x["id"]), ",").alias("ids"), F.array_join(F.transform(nodes, lambda x: x["reason"]), ",").alias("reasons"))


@query("id_lists", "select o_orderkey, o_custkey + 1 as second, 2 as n from orders")
def id_lists(spark, d):
    text = F.concat(F.lit(" ["), F.col("o_custkey").cast("string"), F.lit(", "), (F.col("o_custkey") + 1).cast("string"), F.lit("]"))
    return table(spark, d, "orders").select("o_orderkey", J.id_list(text)[1].alias("second"), F.size(J.id_list(text)).alias("n"))


@query("metadata_merge", "select doc_id, 'b' as a, lang, 2 as n from documents")
def metadata_merge(spark, d):
    left, right = F.create_map(F.lit("k"), F.lit("a"), F.lit("lang"), F.lit("?")), F.create_map(F.lit("k"), F.lit("b"), F.lit("lang"), F.col("lang"), F.lit("_internal"), F.lit("x"))
    m = J.without_keys(J.merged(left, right), "_internal")
    return table(spark, d, "documents").select("doc_id", m["k"].alias("a"), m["lang"].alias("lang"), F.size(m).alias("n"))


@query("layered_values", "select p_partkey, case p_partkey % 3 when 0 then p_brand else 'default' end as value, p_partkey % 4 = 1 as flag, cast(case when p_partkey % 2 = 0 then 1234 else 0 end as bigint) as votes from part")
def layered_values(spark, d):
    k = F.col("p_partkey")
    flag = F.when(k % 4 == 1, " TRUE ").otherwise("off")
    return table(spark, d, "part").select("p_partkey", J.layered(F.when(k % 3 == 0, F.col("p_brand")), F.lit("  "), F.lit("default")).alias("value"), J.is_true(flag).alias("flag"), J.votes(F.when(k % 2 == 0, "1,234").otherwise("none")).alias("votes"))


@query("validators", r"""select item_id, item_id % 3 <> 0 as non_empty, item_id between 1 and 65535 as port, item_id > 0 as positive, item_id % 2 = 0 as url, item_id % 2 = 1 as email, true as ip, item_id % 5 <> 0 as json_ok, case when item_id % 3 = 0 then 'empty' when length(text) > 200 then 'too long' end as error from benchmark""")
def validators(spark, d):
    i, v = F.col("item_id"), J.VALID
    n = i.cast("string")
    address = F.when(i % 2 == 0, F.concat(F.lit("https://example.org/"), n)).otherwise(F.concat(F.lit("a"), n, F.lit("@example.org")))
    body = F.when(i % 3 == 0, "  ").otherwise(F.col("text"))
    return table(spark, d, "benchmark").select("item_id", v["non_empty"](body).alias("non_empty"), v["port"](n).alias("port"), v["positive_int"](n).alias("positive"), v["url"](address).alias("url"), v["email"](address).alias("email"), v["ip"](F.concat(F.lit("10.0.0."), (i % 256).cast("string"))).alias("ip"), v["json"](F.when(i % 5 == 0, "{oops").otherwise('{"a": 1}')).alias("json_ok"), J.query_error(body, 200).alias("error"))


@query("file_routing", """select page_id, case page_id % 4 when 0 then 'code' when 1 then 'pdf' when 2 then 'html' else 'unknown' end as kind, case page_id % 4 when 1 then case when page_id > 100 then 'size' end else 'type' end as error, 'f' || page_id || case page_id % 4 when 0 then '.py' when 1 then '.PDF' when 2 then '.htm' else '' end as name, true as is_url from pages""")
def file_routing(spark, d):
    k = F.col("page_id")
    url = F.concat(F.lit("https://files.example.org/a.b/f"), k.cast("string"), F.when(k % 4 == 0, ".py").when(k % 4 == 1, ".PDF").when(k % 4 == 2, ".htm").otherwise(""), F.lit("?v=1"))
    rows = table(spark, d, "pages").select("page_id", url.alias("url")).withColumn("name", X.file_name_of_url(F.col("url")))
    size = F.when(F.col("page_id") > 100, files.UPLOAD_BYTES + 1).otherwise(10)
    return rows.select("page_id", files.file_type(F.col("name")).alias("kind"), files.upload_error(F.col("name"), size).alias("error"), "name", X.is_object_url(F.col("url")).alias("is_url"))


@query("scan_rules", """select p_partkey, (p_size % 3 = 0 and (p_size % 2 > 0 or p_size * 4 % 100 = 0)) or (p_size % 2 > 0 and p_size * 4 % 100 < 50) or (p_size % 2 = 1 and p_size / 50.0 >= 0.8 and p_size * 4 % 100 < 50) as scanned, p_size >= 8 as kept, case when p_size % 5 = 0 then null when p_size % 3 = 0 then p_name else p_brand end as text from part""")
def scan_rules(spark, d):
    s = F.col("p_size")
    return table(spark, d, "part").select("p_partkey", J.scanned_page(s % 3, s % 2, s * 4 % 100, s / 50.0).alias("scanned"), (s >= 8).alias("kept"), files.first_text(F.when(s % 5 == 0, None).when(s % 3 == 0, F.col("p_name")).otherwise(" "), F.when(s % 5 != 0, F.col("p_brand"))).alias("text"))


@query("table_markdown", """select p_partkey, '| name | brand |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || p_name || ' | ' || p_brand || ' |' || chr(10) || '| ' || p_type || ' |  |' as md from part""")
def table_markdown(spark, d):
    rows = F.array(F.array("p_name", "p_brand", "p_type"), F.array("p_type"))
    return table(spark, d, "part").select("p_partkey", X.markdown_table(F.array(F.lit("name"), F.lit("brand")), rows).alias("md"))


@query("dates", "select event_id, strftime(ts, '%Y%m%d%H%M%S') as stamp, strftime(ts, '%Y-%m-%dT%H:%M:%S') as iso, dayname(ts) as day from events")
def dates(spark, d):
    return table(spark, d, "events").select("event_id", F.date_format("ts", "yyyyMMddHHmmss").alias("stamp"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"), F.date_format("ts", "EEEE").alias("day"))


@query("arrays", "select user_id, array_to_string(list_sort(list(distinct event_type)), ',') as types, array_to_string(list_filter(list_sort(list(distinct event_type)), lambda x: x <> 'click'), ',') as rest from events group by user_id")
def arrays(spark, d):
    rows = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("t"))
    return rows.select("user_id", F.array_join("t", ",").alias("types"), F.array_join(F.array_remove("t", "click"), ",").alias("rest"))


def _folder(spark) -> str:
    """A new folder below the session's checkpoints."""
    ensure_checkpoints(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"


@query("stream_ingest_merge", f"with {ARRIVALS_SQL}, emb as (select l_partkey as id, cast(arg_max(l_suppkey, l_orderkey * 10 + l_linenumber) as double) as embedding from lineitem group by 1) select id, type, description, array_to_string(docs, ',') as docs, embedding, n from ents join ed using (id) join emb using (id)")
def stream_ingest_merge(spark, d):
    """Arrivals as four files, which the stream merges into its state in two batches; the last embedding is kept.

    Lines without an order are no arrivals, but their embeddings count.
    """
    root = _folder(spark)
    known = lambda c: F.when(F.col("known"), F.col(c)).alias(c)
    embedding = F.when(F.col("l_suppkey").isNotNull(), F.array(F.col("l_suppkey").cast("double")))
    rows = _arrivals(spark, d, "left").where("id is not null").select("id", known("type"), known("description"), "source_document", "seq", embedding.alias("embedding"), "place", "known")
    rows.repartition(4).write.parquet(f"{root}/in")
    schema = "id bigint, type string, description string, source_document string, seq bigint, embedding array<double>, place bigint, known boolean"
    parts = (["id"], ["type", "description"], ["embedding"])
    merged = S.MergedStream(spark, f"{root}/merged", schema, lambda rows: M.partial_state(rows, *parts, tie="place", counted="known"), lambda states: M.combined(states, *parts), buckets=8)
    merged.start(f"{root}/in", 2).awaitTermination()
    found = M.from_state(merged.read(), *parts).where("n > 0")
    return found.select("id", "type", "description", F.array_join("source_documents", ",").alias("docs"), F.col("embedding")[0].alias("embedding"), "n")


@query("stream_metrics", "select event_type, count(*) as n, round(sum(value), 4) as total, round(max(value), 4) as most from events group by event_type")
def stream_metrics(spark, d):
    """The state of a running aggregate over the stream of the events' files."""
    name = f"metrics_{uuid.uuid4().hex}"
    source = spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet" if _is_folder(spark, f"{d}/events.parquet") else f"{d}/events.parque*")
    S.running_metrics(source, "event_type", "value").writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


def _is_folder(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


@query("request_windows", "with w as (select user_id, ts, unnest([0, 1, 2]) as k from events), s as (select user_id, time_bucket(interval 1200 seconds, ts) - k * interval 1200 seconds as start from w) select user_id, strftime(start, '%Y-%m-%d %H:%M:%S') as start, count(*) as n from s group by user_id, s.start")
def request_windows(spark, d):
    found = S.request_windows(table(spark, d, "events"), "user_id", "ts", "3600 seconds", "1200 seconds")
    return found.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("session_windows", "with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minutes then 0 else 1 end as f from events), s as (select user_id, ts, sum(f) over (partition by user_id order by ts rows unbounded preceding) as k from g) select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start, strftime(max(ts) + interval 30 minutes, '%Y-%m-%d %H:%M:%S') as finish, count(*) as n from s group by user_id, k")
def session_windows(spark, d):
    day = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return S.sessions(table(spark, d, "events"), "user_id", "ts").select("user_id", day("start").alias("start"), day("end").alias("finish"), "n")


@query("cube_sales", "select l_returnflag, l_linestatus, count(*) as n, round(sum(l_quantity), 2) as quantity from lineitem group by cube (l_returnflag, l_linestatus)")
def cube_sales(spark, d):
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))
