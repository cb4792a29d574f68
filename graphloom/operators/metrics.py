"""Ranking metrics, latency and trajectory statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CUTS = (1, 5, 10, 20)


def ranked_lists(rows: DataFrame, query: str = "query", item: str = "doc", rank: str = "rank") -> DataFrame:
    """(query, predicted): each query's items in order of rank, as an array."""
    return rows.groupBy(query).agg(F.transform(F.array_sort(F.collect_list(F.struct(rank, item))), lambda x: x[item]).alias("predicted"))


def ranking_metrics(queries: DataFrame) -> DataFrame:
    """(query, hit@k, recall@k, recall@all, mrr) of (query, predicted, gold) arrays; an empty gold set gives zeros."""
    gold = F.array_distinct("gold")
    size = F.greatest(F.size(gold), F.lit(1))
    out = {}
    for k in CUTS:
        top = F.slice("predicted", 1, k)
        out[f"hit_{k}"] = F.arrays_overlap(top, gold).cast("int")
        out[f"recall_{k}"] = F.size(F.array_intersect(top, gold)) / size
    out["recall_all"] = F.size(F.array_intersect("predicted", gold)) / size
    places = F.filter(F.transform("predicted", lambda x, i: F.when(F.array_contains(gold, x), i + 1)), lambda x: x.isNotNull())
    out["mrr"] = F.when(F.size(places) > 0, 1.0 / F.try_element_at(places, F.lit(1))).otherwise(0.0)
    return queries.withColumns({k: F.coalesce(v.cast("double"), F.lit(0.0)) for k, v in out.items()}).drop("predicted", "gold")


def summary(rows: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    """One row (metric, n, mean, std, stderr) for each column."""
    parts = F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns)))
    out = rows.select(parts.alias("p")).select("p.metric", "p.value").groupBy("metric").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    return out.select("metric", "n", F.round("mean", digits).alias("mean"), F.round("std", digits).alias("std"), F.round(F.col("std") / F.sqrt("n"), digits).alias("stderr"))


def prefix_mean(rows: DataFrame, order: str, value: str, within: str | None = None) -> DataFrame:
    """Rows with the mean of `value` over all rows up to each.

    `within` names groups; without one a total order is asked for, which puts all rows in one task, so use it on summaries.
    """
    own = (Window.partitionBy(within) if within else Window.partitionBy(F.lit(0))).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("running", F.round(F.avg(value).over(own), 6))


def latency(runs: DataFrame, steps: int) -> DataFrame:
    """(question, latency): the longest time that any agent (question, agent, step_times) needs for up to `steps` steps."""
    at = F.try_element_at("step_times", F.least(F.lit(steps), F.size("step_times")))
    return runs.groupBy("question").agg(F.max(at).alias("latency"))


def grid(runs: DataFrame, agents: list[int], steps: list[int]) -> DataFrame:
    """(n_agents, max_steps, questions, latency): the mean latency in each cell of a grid of parameters."""
    cells = F.array(*(F.struct(F.lit(a).alias("n_agents"), F.lit(t).alias("max_steps")) for a in agents for t in steps))
    rows = runs.select("question", "agent", "step_times", F.explode(cells).alias("c")).where("agent < c.n_agents")
    at = F.try_element_at("step_times", F.least(F.col("c.max_steps"), F.size("step_times")))
    each = rows.groupBy("c", "question").agg(F.max(at).alias("latency"))
    return each.groupBy("c").agg(F.count("*").alias("questions"), F.round(F.avg("latency"), 6).alias("latency")).select("c.n_agents", "c.max_steps", "questions", "latency")


def tool_counts(calls: DataFrame, key: str, tool: str, tools: list[str]) -> DataFrame:
    """(key, one column of counts for each tool, total, one share for each tool)."""
    out = calls.groupBy(key).pivot(tool, tools).count().na.fill(0, tools)
    total = sum((F.col(t) for t in tools), F.lit(0))
    out = out.withColumn("total", total.cast("long"))
    return out.withColumns({f"{t}_share": F.round(F.when(F.col("total") > 0, F.col(t) / F.col("total")).otherwise(0.0), 6) for t in tools})


def tool_summary(counts: DataFrame, tools: list[str]) -> DataFrame:
    """(tool, mean, median, most) of per-key counts."""
    rows = counts.select(F.explode(F.array(*(F.struct(F.lit(t).alias("tool"), F.col(t).alias("n")) for t in tools))).alias("x")).select("x.tool", "x.n")
    return rows.groupBy("tool").agg(F.round(F.avg("n"), 6).alias("mean"), F.percentile("n", F.lit(0.5)).alias("median"), F.max("n").alias("most"))


def histogram(counts: DataFrame, column: str, most: int = 30) -> DataFrame:
    """(bin, n, percent): rows by value, all values from `most` on in the last bin."""
    total = counts.agg(F.count("*").alias("total"))
    rows = counts.groupBy(F.least(F.col(column), F.lit(most)).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    return rows.crossJoin(F.broadcast(total)).select("bin", "n", F.round(100.0 * F.col("n") / F.col("total"), 6).alias("percent"))


def tool_use(calls: DataFrame, key: str, tool: str, order: list[str]) -> DataFrame:
    """(key, first_tool, after_first, only_tool): the first tool, whether it comes again, and whether it is the only one."""
    place = F.struct(*order)
    out = calls.groupBy(key).agg(F.min_by(tool, place).alias("first_tool"), F.count_distinct(tool).alias("n_tools"), F.count("*").alias("n"))
    firsts = calls.join(out.select(key, "first_tool"), key).groupBy(key).agg(F.count_if(F.col(tool) == F.col("first_tool")).alias("times"))
    return out.join(firsts, key).select(key, "first_tool", (F.col("times") > 1).alias("after_first"), (F.col("n_tools") == 1).alias("only_tool"))


def breakdown(used: DataFrame) -> DataFrame:
    """(first_tool, n, again, alone)."""
    return used.groupBy("first_tool").agg(F.count("*").alias("n"), F.count_if(F.col("after_first")).alias("again"), F.count_if(F.col("only_tool")).alias("alone"))


def best_trajectories(runs: DataFrame, copies: int = 3) -> DataFrame:
    """(question, run, recall, messages, copy): for each question the run with the best recall, then the fewest messages.

    Questions whose best recall is zero go; each that stays is repeated.
    """
    own = Window.partitionBy("question").orderBy(F.desc("recall"), "messages", "run")
    best = runs.withColumn("_n", F.row_number().over(own)).where("_n = 1 and recall > 0").drop("_n")
    return best.select("*", F.explode(F.sequence(F.lit(1), F.lit(copies))).alias("copy"))


def shared_only(rows: DataFrame, key: str, group: str, groups: list) -> DataFrame:
    """Rows whose key occurs in every group."""
    n = rows.where(F.col(group).isin(groups)).groupBy(key).agg(F.count_distinct(group).alias("_n")).where(F.col("_n") == len(groups))
    return rows.join(n.select(key), key, "left_semi")


def pipeline_statistics(events: DataFrame, value: str, items: str) -> DataFrame:
    """Totals of an event log: (queries, mean_latency, max_latency, mean_items)."""
    return events.agg(F.count("*").alias("queries"), F.round(F.avg(value), 4).alias("mean_latency"), F.round(F.max(value), 4).alias("max_latency"), F.round(F.avg(items), 4).alias("mean_items"))


def requests_in_window(events: DataFrame, key: str, ts: str, seconds: int = 60) -> DataFrame:
    """Events with the number of the same key's events in the seconds up to each."""
    at = F.col(ts).cast("timestamp")
    own = Window.partitionBy(key).orderBy(F.unix_micros(at)).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("recent", F.count("*").over(own))


def share(condition: Column) -> Column:
    return F.round(F.avg(condition.cast("double")), 6)
