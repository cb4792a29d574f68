"""Scores added up in tasks against postings that are joined with the queries."""

from random import Random

import pytest

from graphloom.operators import search as S
from graphloom.operators import term_scores as T


@pytest.fixture(scope="module")
def tables(spark):
    random = Random(5)
    words = [f"w{k}" for k in range(40)]
    texts = [" ".join(random.choices(words, [1 / (k + 1) for k in range(40)], k=random.randrange(1, 50))) for _ in range(300)]
    docs = spark.createDataFrame([*enumerate(texts), *((k, "w1 w2 w30 W30") for k in range(400, 450)), (900, None), (901, ""), (902, "É w1")], "id int, text string").repartition(3)
    asked = spark.createDataFrame([("a", "w1 w1 w30"), ("b", "w2 É"), ("c", "nothing"), ("d", "w0"), ("e", None), ("a", "w7"), (None, "w3 w5")], "q string, text string")
    return docs, asked


def rows(df, digits=9):
    return sorted((str(r.query), r.doc, round(r.score, digits), r.matched) for r in df.collect())


def joined(monkeypatch, *given, **more):
    with monkeypatch.context() as m:
        m.setattr(S, "fits", lambda df: False)
        return S.bm25(*given, "id", "text", "q", "text", **more)


@pytest.mark.parametrize("more", [{}, {"okapi": True, "k1": 1.5}, {"all_terms": True}])
@pytest.mark.parametrize("cells", [T.MOST_CELLS, 30])
def test_like_joined_postings(spark, tables, monkeypatch, more, cells):
    monkeypatch.setattr(T, "MOST_CELLS", cells)
    monkeypatch.setattr(T, "MOST_PARTS", cells)
    want, got = joined(monkeypatch, *tables, **more), S.bm25(*tables, "id", "text", "q", "text", **more)
    assert got.schema.simpleString() == want.schema.simpleString()
    assert rows(got) == rows(want) and rows(want)
    for k in (1, 4, 500):
        assert rows(S.bm25_top(*tables, "id", "text", "q", "text", k, **more), 6) == rows(S.top_per_query(want, k), 6)


def test_tasks_pass_on_few_rows(tables):
    """A pair of a document and a query that cannot be among the best leaves no task, also where many texts are equal."""
    docs, asked = tables
    every, best = (S.bm25(docs, asked, "id", "text", "q", "text", best=k).count() for k in (None, 4))
    assert every > 1000 and best <= 6 * 4 * 3 * 3
    whole = S.bm25(docs, asked, "id", "text", "q", "text", best=4, whole=True).where("query = 'd'")
    assert whole.count() == docs.where("text rlike '\\\\bw0\\\\b'").count()  # each holds the one term of the query


def test_ids_that_repeat_and_nothing(spark, tables, monkeypatch):
    docs, asked = tables
    twice = docs.union(docs.where("id < 20"))
    assert rows(S.bm25(twice, asked, "id", "text", "q", "text")) == rows(joined(monkeypatch, twice, asked))
    assert S.bm25_top(docs.where("false"), asked, "id", "text", "q", "text", 3).collect() == []
    assert S.bm25_top(docs, asked.where("false"), "id", "text", "q", "text", 3).collect() == []


def test_columns_beside_documents(spark, tables, monkeypatch):
    """Columns meet documents before pairs are made: scores are as if joined afterwards, and no join reads the pairs."""
    docs, asked = tables
    beside = docs.where("id % 3 = 0").selectExpr("id as doc", "id * 2 as twice", "if(id % 2 = 0, null, text) as note")
    beside = beside.union(beside.where("doc < 30"))
    found = S.bm25(*tables, "id", "text", "q", "text", beside=beside)
    want = S.bm25(*tables, "id", "text", "q", "text").join(beside, "doc").select("query", "doc", "score", "matched", "twice", "note")
    both = lambda df: sorted((str(r.query), r.doc, round(r.score, 9), r.matched, r.twice, str(r.note)) for r in df.collect())
    assert found.columns == want.columns and both(found) == both(want)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("Join")
    joined_ = joined(monkeypatch, *tables, beside=beside)
    assert joined_.columns == want.columns and both(joined_) == both(want)


def test_category_rescore_joins_no_pairs(spark):
    from graphloom.plans import catalog

    plan = catalog.queries()["category_rescore"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("Join")
