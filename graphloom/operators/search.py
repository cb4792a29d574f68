"""Ranked text search over postings (doc, term, tf)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import tokens
from graphloom.operators import term_scores as T
from graphloom.operators.sizes import fits, sent_if


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, term, tf) of all terms."""
    rows = docs.select(F.col(id_col).alias("doc"), F.explode_outer(tokens(F.col(text_col))).alias("term")).where("term is not null")
    return rows.groupBy("doc", "term").agg(F.count("*").alias("tf"))


def query_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(query, term, qtf)."""
    return queries.select(F.col(id_col).alias("query"), F.explode(tokens(F.col(text_col))).alias("term")).groupBy("query", "term").agg(F.count("*").alias("qtf"))


def bm25(docs: DataFrame, queries: DataFrame, doc_id: str, doc_text: str, query_id: str, query_text: str, k1: float = 1.2, b: float = 0.75, okapi: bool = False, all_terms: bool = False, best: int | None = None, whole: bool = False, beside: DataFrame | None = None) -> DataFrame:
    """(query, doc, score, matched) of all documents that share a term with a query.

    idf is ln(1 + (N - n + .5) / (n + .5)); with `okapi` it is ln((N - n + .5) / (n + .5)), and a negative one becomes a
    quarter of the mean over all terms. all_terms keeps documents that hold every term. With `best`, rows may be missing that
    `top_per_query` would not count among a query's best so many; with `whole` too, none is whose document holds every term.
    `beside`, a table (doc, ...), keeps its documents only and adds its columns; it meets documents, so that pairs need no join.

    Texts are split once; what they hold of the queries' terms is stored, and a task adds up the scores of its documents. Where
    the queries are too many for that, or ids repeat, postings of their own terms are grouped and joined, with their
    document's length beside them.
    """
    terms = query_terms(queries, query_id, query_text)
    small = fits(terms)  # the idf table has a row for each of their terms at most
    if small:
        asked = T.QueryTerms(terms)
        words = tokens(F.coalesce(F.col(doc_text), F.lit("")))
        held = T.held_terms(docs, asked, words, doc_id)
        n_docs, ids, avgdl = held.agg(F.count("*"), F.count_distinct("doc"), F.avg("dl")).first()
        if n_docs == ids:
            df = np.zeros(len(asked.names))
            for term, n in held.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
                df[term] = n
            odds = (n_docs - df + 0.5) / (df + 0.5)
            idf = np.log(odds if okapi else 1 + odds)
            if okapi and (idf < 0).any():
                every = docs.select(F.explode(F.array_distinct(words)).alias("term")).groupBy("term").agg(F.count("*").cast("double").alias("df"))
                idf = np.where(idf < 0, 0.25 * every.agg(F.avg(F.log(n_docs - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))).first()[0], idf)
            if beside is not None:
                held = held.join(beside, "doc")
            return T.scored(held, asked, idf, avgdl or 1.0, k1, b, all_terms, best, whole)
    own = sent_if(small, terms.select("term").distinct())
    split = docs.select(F.col(doc_id).alias("doc"), tokens(F.coalesce(F.col(doc_text), F.lit(""))).alias("w"))
    size = split.agg(F.count("*").cast("double").alias("n_docs"), F.avg(F.size("w")).alias("avgdl"))
    rows = split.select("doc", F.size("w").cast("double").alias("dl"), F.explode_outer("w").alias("term"))
    posts = rows.join(own, "term", "left_semi").groupBy("doc", "dl", "term").agg(F.count("*").alias("tf"))
    if okapi:
        df = rows.where("term is not null").groupBy("term").agg(F.count_distinct("doc").cast("double").alias("df"))
        raw = F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
        every = df.crossJoin(F.broadcast(size)).select("term", raw.alias("raw"))
        mean = every.agg(F.avg("raw").alias("mean"))
        idf = every.join(own, "term", "left_semi").crossJoin(F.broadcast(mean)).select("term", F.when(F.col("raw") < 0, 0.25 * F.col("mean")).otherwise(F.col("raw")).alias("idf"))
    else:
        df = posts.groupBy("term").agg(F.count("*").cast("double").alias("df"))
        idf = df.crossJoin(F.broadcast(size)).select("term", F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    weight = F.col("qtf") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    # a posting meets every query that has its term, so postings are spread by document before they grow; the sums need no other shuffle
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hits = posts.repartition(n, "doc").join(sent_if(small, terms), "term").join(sent_if(small, idf), "term").crossJoin(F.broadcast(size))
    out = hits.groupBy("query", "doc").agg(F.sum(weight).alias("score"), F.count("*").alias("matched"))
    if all_terms:
        wanted = terms.groupBy("query").agg(F.count("*").alias("wanted"))
        out = out.join(wanted, "query").where("matched = wanted").drop("wanted")
    if beside is not None:  # pairs are never the side that is broadcast
        out = out.join(F.broadcast(beside), "doc") if fits(beside) else out.hint("merge").join(beside, "doc")
        out = out.select("query", "doc", "score", "matched", *(c for c in beside.columns if c != "doc"))
    return out


def top_per_query(scored: DataFrame, k: int, by: str = "query", item: str = "doc", score: str = "score", digits: int = 6) -> DataFrame:
    """The best `k` rows of each query with positive rounded scores, ties by item, with their rank."""
    rounded = scored.withColumn(score, F.round(score, digits)).where(F.col(score) > 0)
    own = Window.partitionBy(by).orderBy(F.desc(score), item)
    return rounded.withColumn("rank", F.row_number().over(own).cast("long")).where(F.col("rank") <= k)


def bm25_top(docs: DataFrame, queries: DataFrame, doc_id: str, doc_text: str, query_id: str, query_text: str, k: int, **more) -> DataFrame:
    """(query, doc, score, matched, rank): the best `k` documents of each query; tasks pass on little besides."""
    return top_per_query(bm25(docs, queries, doc_id, doc_text, query_id, query_text, best=k, **more), k)


def fields_search(docs: DataFrame, queries: DataFrame, doc_id: str, fields: list[str], query_id: str, query_text: str) -> DataFrame:
    """(query, doc, score): scores of several fields added, each field an index of its own."""
    out = None
    for field in fields:
        part = bm25(docs, queries, doc_id, field, query_id, query_text).select("query", "doc", "score")
        out = part if out is None else out.union(part)
    return out.groupBy("query", "doc").agg(F.sum("score").alias("score"))


def group_bm25(candidates: DataFrame, group: str, item: str, text: str, query: str, k1: float = 1.5, b: float = 0.75, texts: DataFrame | None = None) -> DataFrame:
    """(group, item, score) for one query, with each group's own candidates as the corpus.

    texts: a table (item, text) with each item once, where candidates have no text of their own; its words are counted before
    they meet the groups, so an item's text is split once and never moved. A group's counts are one row of numbers.
    """
    wanted = F.array_distinct(F.filter(F.split(F.lower(F.lit(query)), r"\s+"), lambda w: w != ""))
    terms = candidates.sparkSession.range(1).select(wanted).first()[0]
    split = (candidates if texts is None else texts).withColumn("w", F.filter(F.split(F.lower(F.col(text)), r"\s+"), lambda w: w != ""))
    counts = {f"t{k}": F.size(F.filter("w", F.lit(t).eqNullSafe)) for k, t in enumerate(terms)}
    counted = split.select(*([F.col(group).alias("g")] if texts is None else []), F.col(item).alias("i"), F.size("w").alias("dl"), *(v.alias(k) for k, v in counts.items()))
    rows = counted if texts is None else candidates.select(F.col(group).alias("g"), F.col(item).alias("i")).join(counted, "i")
    sizes = rows.groupBy("g").agg(F.count("*").cast("double").alias("n"), F.avg("dl").alias("avgdl"), *(F.sum((F.col(k) > 0).cast("double")).alias(f"df_{k}") for k in counts))

    def weight(k: str) -> Column:
        tf, df = F.col(k), F.col(f"df_{k}")
        idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        return F.when(tf > 0, idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))).otherwise(0.0)

    hits = rows.where(F.greatest(F.lit(0), F.lit(0), *counts) > 0)
    score = sum(map(weight, counts), F.lit(0.0))
    return hits.join(sizes, "g").groupBy(F.col("g").alias(group), F.col("i").alias(item)).agg(F.sum(score).alias("score"))


def keyword_filter(rows: DataFrame, query: str, name: str, summary: str, key: str, stopwords: list[str]) -> DataFrame:
    """(key, name, bucket, relevance): names that hold the query first, then rows by how many of its words the summary holds."""
    words = [w for w in query.replace("-", " ").lower().split() if w not in stopwords]
    inside = F.lower(F.coalesce(F.col(summary), F.lit("")))
    count = sum((inside.contains(w).cast("long") for w in words), F.lit(0).cast("long"))
    named = F.lower(F.col(name)).contains(query.lower())
    out = rows.where(F.col(name).isNotNull()).select(F.col(key), F.col(name), F.when(named, 0).otherwise(1).cast("long").alias("bucket"), F.when(named, 0).otherwise(count).cast("long").alias("relevance"))
    return out.where("bucket = 0 or relevance > 0")
