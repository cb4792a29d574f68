"""Queries of ranking evaluation and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import metrics as M
from graphloom.operators import search as S
from graphloom.operators.components import ensure_checkpoints
from graphloom.operators.sizes import fits, sent_if
from graphloom.plans.base import query, table
from graphloom.plans.text import _bm25_sql

GOLD_SQL = "gold as (select b.item_id as query, list_sort(list(d.doc_id)) as gold from benchmark b join documents d on contains(d.text, b.text) group by b.item_id)"
PRED_SQL = f"pred as (with {_bm25_sql('documents', 'doc_id', 'text', 1.2, False)} select query, list(doc order by s desc, doc) as predicted from (select *, row_number() over (partition by query order by s desc, doc) as rank from (select query, doc, round(score, 6) as s from sc) where s > 0) where rank <= 20 group by query)"
PAIR_SQL = f"{PRED_SQL}, {GOLD_SQL}, pair as (select item_id as query, coalesce(predicted, []) as p, coalesce(gold, []) as g from benchmark left join pred on item_id = pred.query left join gold on item_id = gold.query)"
METRICS_SQL = f"{PAIR_SQL}, m as (select query, " + ", ".join(f"cast(list_has_any(p[1:{k}], g) as double) as hit_{k}, len(list_intersect(p[1:{k}], g)) / cast(greatest(len(g), 1) as double) as recall_{k}" for k in M.CUTS) + ", len(list_intersect(p, g)) / cast(greatest(len(g), 1) as double) as recall_all, coalesce(1.0 / list_min(list_filter(list_transform(g, lambda x: list_position(p, x)), lambda i: i > 0)), 0.0) as mrr from pair)"


def _evaluated(spark, d):
    """Metrics of BM25 against the documents that hold an item's whole text.

    Only documents with all of an item's words, which the postings give, are compared as texts.
    """
    docs, items = table(spark, d, "documents"), table(spark, d, "benchmark")
    ensure_checkpoints(spark)
    found = S.bm25(docs, items, "doc_id", "text", "item_id", "text", best=20, whole=True).checkpoint()  # read twice
    top = S.top_per_query(found, 20)
    wanted = S.query_terms(items, "item_id", "text").groupBy("query").agg(F.count("*").alias("wanted"))
    both = found.join(wanted, "query").where("matched = wanted").select("query", "doc")
    both = sent_if(fits(both), both)  # few pairs go to the texts
    inside = both.join(docs.select(F.col("doc_id").alias("doc"), F.col("text").alias("d")), "doc").join(items.select(F.col("item_id").alias("query"), F.col("text").alias("t")), "query").where(F.contains("d", "t"))
    gold = inside.groupBy("query").agg(F.array_sort(F.collect_list("doc")).alias("gold"))
    none = F.expr("cast(array() as array<bigint>)")
    pairs = items.select(F.col("item_id").alias("query")).join(M.ranked_lists(top), "query", "left").join(gold, "query", "left")
    return M.ranking_metrics(pairs.select("query", F.coalesce("predicted", none).alias("predicted"), F.coalesce("gold", none).alias("gold")))


@query("eval_hit_recall_mrr", f"with {METRICS_SQL} select query, " + ", ".join(f"hit_{k}, round(recall_{k}, 6) as recall_{k}" for k in M.CUTS) + ", round(recall_all, 6) as recall_all, round(cast(mrr as double), 6) as mrr from m")
def eval_hit_recall_mrr(spark, d):
    found = _evaluated(spark, d)
    return found.select("query", *(F.round(c, 6).alias(c) for c in found.columns if c != "query"))


@query("metric_stderr", f"with {METRICS_SQL}, l as (select 'hit_1' as metric, hit_1 as v from m union all select 'recall_20', recall_20 from m union all select 'mrr', cast(mrr as double) from m) select metric, count(v) as n, round(avg(v), 6) as mean, round(stddev_samp(v), 6) as std, round(stddev_samp(v) / sqrt(count(v)), 6) as stderr from l group by metric")
def metric_stderr(spark, d):
    return M.summary(_evaluated(spark, d), ["hit_1", "recall_20", "mrr"])


@query("running_mean", f"with {METRICS_SQL} select query, round(cast(mrr as double), 6) as mrr, round(avg(cast(mrr as double)) over (order by query rows unbounded preceding), 6) as running from m")
def running_mean(spark, d):
    return M.prefix_mean(_evaluated(spark, d).select("query", F.col("mrr").alias("m")), "query", "m").select("query", F.round("m", 6).alias("mrr"), "running")


@query("metric_suffix", f"with {METRICS_SQL} select query, hit_1 as hit_1_bm25, round(cast(mrr as double), 6) as mrr_bm25 from m")
def metric_suffix(spark, d):
    rows = _evaluated(spark, d).select("query", "hit_1", F.round("mrr", 6).alias("mrr"))
    return rows.withColumnsRenamed({c: f"{c}_bm25" for c in ("hit_1", "mrr")})


RUNS_SQL = "runs as (select strftime(ts, '%Y-%m-%d') as question, user_id % 3 as agent, list(round(value, 3) order by ts, event_id) as step_times from events group by 1, 2)"


def _runs(spark, d):
    events = table(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("question"), (F.col("user_id") % 3).alias("agent"), F.struct("ts", "event_id", F.round("value", 3).alias("v")).alias("s"))
    return events.groupBy("question", "agent").agg(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["v"]).alias("step_times"))


@query("agent_latency", f"with {RUNS_SQL} select question, max(step_times[least(10, len(step_times))]) as latency from runs group by question")
def agent_latency(spark, d):
    return M.latency(_runs(spark, d), 10)


@query("eval_grid", f"with {RUNS_SQL}, a(n_agents) as (values (1), (2), (3)), t(max_steps) as (values (5), (10), (20)), x as (select n_agents, max_steps, question, max(step_times[least(max_steps, len(step_times))]) as l from runs, a, t where agent < n_agents group by all) select n_agents, max_steps, count(*) as questions, round(avg(l), 6) as latency from x group by all")
def eval_grid(spark, d):
    return M.grid(_runs(spark, d), [1, 2, 3], [5, 10, 20])


@query("ablation_shared", "with s as (select user_id from events where event_type in ('click', 'error') group by user_id having count(distinct event_type) = 2) select event_id, user_id, event_type from events where user_id in (select user_id from s)")
def ablation_shared(spark, d):
    return M.shared_only(table(spark, d, "events"), "user_id", "event_type", ["click", "error"]).select("event_id", "user_id", "event_type")


@query("metrics_merged", "with c as (select user_id, count(*) as n from events where event_type = 'click' group by 1), v as (select user_id, round(avg(value), 6) as mean from events where event_type = 'view' group by 1) select user_id, n, mean from c join v using (user_id)")
def metrics_merged(spark, d):
    events = table(spark, d, "events")
    clicks = events.where("event_type = 'click'").groupBy("user_id").agg(F.count("*").alias("n"))
    return clicks.join(events.where("event_type = 'view'").groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("mean")), "user_id")


@query("pipeline_metrics", "select count(*) as queries, round(avg(value), 4) as mean_latency, round(max(value), 4) as max_latency, round(avg(cast(json_extract_string(props, '$.k') as bigint)), 4) as mean_items from events where event_type = 'view'")
def pipeline_metrics(spark, d):
    events = table(spark, d, "events").where("event_type = 'view'").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return M.pipeline_statistics(events, "value", "k")


@query("last_errors", "select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as ts, round(value, 6) as value from (select * from events) e where event_type = 'error' order by e.ts desc, event_id desc limit 5")
def last_errors(spark, d):
    return table(spark, d, "events").where("event_type = 'error'").orderBy(F.desc("ts"), F.desc("event_id")).limit(5).select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), F.round("value", 6).alias("value"))


@query("rerank_scores", f"with {_bm25_sql('documents', 'doc_id', 'text', 1.2, False)} select query, round(min(score), 4) as low, round(max(score), 4) as high, round(avg(score), 4) as mean from sc group by query")
def rerank_scores(spark, d):
    scored = S.bm25(table(spark, d, "documents"), table(spark, d, "benchmark"), "doc_id", "text", "item_id", "text")
    return scored.groupBy("query").agg(F.round(F.min("score"), 4).alias("low"), F.round(F.max("score"), 4).alias("high"), F.round(F.avg("score"), 4).alias("mean"))


@query("retrieval_rates", "select lang, round(avg(cast(quality = 1 as double)), 6) as match_rate, round(avg(cast(toxic = 1 as double)), 6) as flagged_rate, round(avg(n_chars), 6) as mean_chars from documents join labels using (doc_id) group by lang")
def retrieval_rates(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return rows.groupBy("lang").agg(M.share(F.col("quality") == 1).alias("match_rate"), M.share(F.col("toxic") == 1).alias("flagged_rate"), F.round(F.avg("n_chars"), 6).alias("mean_chars"))


@query("requests_in_window", "select event_id, count(*) over (partition by user_id order by ts range between interval 3600 seconds preceding and current row) as recent from events")
def requests_in_window(spark, d):
    return M.requests_in_window(table(spark, d, "events"), "user_id", "ts", 3600).select("event_id", "recent")
