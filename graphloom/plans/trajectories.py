"""Queries over tool calls and conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from graphloom.operators import metrics as M
from graphloom.plans.base import query, table

TOOLS = ["signup", "error", "click", "view", "purchase"]
COUNTS_SQL = "c as (select user_id, " + ", ".join(f"count(*) filter (event_type = '{t}') as {t}" for t in TOOLS) + ", count(*) as total from events group by user_id)"


@query("tool_counts_pivot", f"with {COUNTS_SQL} select *, " + ", ".join(f"round({t} / cast(total as double), 6) as {t}_share" for t in TOOLS) + " from c")
def tool_counts_pivot(spark, d):
    return M.tool_counts(table(spark, d, "events"), "user_id", "event_type", TOOLS)


@query("tool_summary", f"with {COUNTS_SQL}, l as (" + " union all ".join(f"select '{t}' as tool, {t} as n from c" for t in TOOLS) + ") select tool, round(avg(n), 6) as mean, quantile_cont(n, 0.5) as median, max(n) as most from l group by tool")
def tool_summary(spark, d):
    return M.tool_summary(M.tool_counts(table(spark, d, "events"), "user_id", "event_type", TOOLS), TOOLS)


@query("tool_histogram", f"with {COUNTS_SQL} select least(click, 30) as bin, count(*) as n, round(100.0 * count(*) / (select count(*) from c), 6) as percent from c group by 1")
def tool_histogram(spark, d):
    return M.histogram(M.tool_counts(table(spark, d, "events"), "user_id", "event_type", TOOLS), "click")


USE_SQL = "u as (select user_id, arg_min(event_type, (ts, event_id)) as first_tool, count(distinct event_type) as k from events group by user_id), w as (select user_id, first_tool, (select count(*) from events e where e.user_id = u.user_id and e.event_type = first_tool) > 1 as after_first, k = 1 as only_tool from u)"


@query("first_tool", f"with {USE_SQL} select * from w")
def first_tool(spark, d):
    return M.tool_use(table(spark, d, "events"), "user_id", "event_type", ["ts", "event_id"])


@query("first_tool_breakdown", f"with {USE_SQL} select first_tool, count(*) as n, count(*) filter (after_first) as again, count(*) filter (only_tool) as alone from w group by first_tool")
def first_tool_breakdown(spark, d):
    return M.breakdown(M.tool_use(table(spark, d, "events"), "user_id", "event_type", ["ts", "event_id"]))


RUNS_SQL = "r as (select conv_id % 20 as question, conv_id as run, round(sum(cast(role = 'assistant' as double)) / 4, 6) as recall, count(*) as messages from conversations group by conv_id), r2 as (select question, run, case when run % 7 = 0 then 0.0 else recall end as recall, messages from r)"


def _runs(spark, d):
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.round(F.sum((F.col("role") == "assistant").cast("double")) / 4, 6).alias("recall"), F.count("*").alias("messages"))
    return rows.select((F.col("conv_id") % 20).alias("question"), F.col("conv_id").alias("run"), F.when(F.col("conv_id") % 7 == 0, 0.0).otherwise(F.col("recall")).alias("recall"), "messages")


@query("rejection_sampling", f"with {RUNS_SQL}, b as (select *, row_number() over (partition by question order by recall desc, messages, run) as n from r2) select question, run, cast(recall as double) as recall, messages, unnest([1, 2, 3]) as copy from b where n = 1 and recall > 0")
def rejection_sampling(spark, d):
    return M.best_trajectories(_runs(spark, d))


@query("merged_turns", r"""with t as (select *, case when role = 'assistant' then 'assistant' else 'user' end as side from conversations where role <> 'system'), l as (select *, lag(side) over (partition by conv_id order by turn) as before from t),
i as (select *, sum(case when side is distinct from before then 1 else 0 end) over (partition by conv_id order by turn) as island from l)
select conv_id, cast(island as bigint) as island, side, count(*) as n, md5(string_agg(text, chr(10) order by turn)) as digest from i group by conv_id, island, side""")
def merged_turns(spark, d):
    own = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, d, "conversations").where("role <> 'system'").withColumn("side", F.when(F.col("role") == "assistant", "assistant").otherwise("user"))
    rows = rows.withColumn("before", F.lag("side").over(own))
    rows = rows.withColumn("island", F.sum((~F.col("side").eqNullSafe(F.col("before"))).cast("long")).over(own))
    parts = rows.groupBy("conv_id", "island", "side").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return parts.select("conv_id", "island", "side", "n", F.md5(F.array_join(F.transform("t", lambda x: x["text"]), "\n")).alias("digest"))


@query("system_prompts", "select conv_id, text as system from conversations where role = 'system'")
def system_prompts(spark, d):
    return table(spark, d, "conversations").where("role = 'system'").select("conv_id", F.col("text").alias("system"))


@query("history_tail", "select conv_id, turn, role from (select *, row_number() over (partition by conv_id order by turn desc) as n from conversations) where n <= 6")
def history_tail(spark, d):
    own = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return table(spark, d, "conversations").withColumn("n", F.row_number().over(own)).where("n <= 6").select("conv_id", "turn", "role")


@query("oracle_trajectory", """with a as (select user_id, list(cast(json_extract_string(props, '$.k') as bigint) order by ts, event_id) as k from events group by user_id),
x as (select user_id, list_filter(k, lambda v, i: list_position(k, v) = i and v % 10 <> 9) as k from a) select user_id, cast(to_json(k[1:8]) as varchar) as searches, len(k) as answers from x""")
def oracle_trajectory(spark, d):
    rows = table(spark, d, "events").select("user_id", F.struct("ts", "event_id", F.get_json_object("props", "$.k").cast("long").alias("k")).alias("s"))
    lists = rows.groupBy("user_id").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["k"])).alias("k"))
    valid = lists.select("user_id", F.filter("k", lambda v: v % 10 != 9).alias("k"))
    return valid.select("user_id", F.to_json(F.slice("k", 1, 8)).alias("searches"), F.size("k").cast("long").alias("answers"))
