"""Attempts of adaptive retrieval: each search runs once, whatever the attempts after it."""

from pyspark.sql import functions as F

from graphloom.operators import retrieve as R
from graphloom.operators import search as S


def test_a_search_is_not_repeated(spark):
    docs = spark.createDataFrame([(k, f"w{k} common x{k % 3}") for k in range(30)], "doc long, body string")
    asked = spark.createDataFrame([(1, "w1 common"), (2, "x1 missing gone lost"), (3, "nothing")], "query long, text string")
    search = lambda q: S.top_per_query(S.bm25(docs, q, "doc", "body", "query", "text"), 3).select("query", "doc", "rank")
    found = R.adaptive(asked, search, docs, lambda t: F.slice(F.split(t, " "), 1, 1)[0], relevant_from=0.9)
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.select("query", "doc", "attempt").collect()))[-3:] == [(2, 1, 1), (2, 4, 1), (2, 7, 1)]
