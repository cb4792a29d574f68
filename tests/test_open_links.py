"""Queries about some nodes read the tables for these alone: no graph is stored for them, and the rows are the same."""

import pytest

from graphloom.operators import components as C
from graphloom.operators import search as S
from graphloom.operators import traverse as G
from graphloom.plans import catalog
from graphloom.sources import star

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=str)


@pytest.mark.parametrize("name", ["neighbours_1hop", "search_neighbourhood", "lossless_format", "khop2_edges_induced", "connected_components", "neighbour_bm25", "local_search"])
def test_no_graph_is_stored(spark, monkeypatch, name):
    monkeypatch.setattr(star, "_STORED", {})
    assert catalog.queries()[name](spark, SF).count() > 0
    assert not star._STORED


@pytest.mark.parametrize("most", [5, 1000])
def test_same_as_stored(spark, monkeypatch, most):
    monkeypatch.setattr(G, "NAMED_SEEDS", most)
    stored, open_ = star.links(spark, SF), star.OpenLinks(spark, SF)
    seeds = spark.createDataFrame([(k * star.SCALE + i,) for k in (2, 3, 4, 5) for i in (1, 2)] + [(77,), (None,)], "index long")
    for f in (lambda e: G.neighbours(e, seeds), lambda e: G.expand(e, seeds, 3), lambda e: G.subgraph_edges(e, seeds), lambda e: G.subgraph_edges(e, G.within_hops(e, seeds, 1), False)):
        assert rows(f(open_)) == rows(f(stored))
    members = star.nodes(spark, SF).selectExpr("index", "index % 3 as community")
    assert rows(C.inner_edges(open_, members, 4)) == rows(C.inner_edges(stored, members, 4))


def test_texts_beside_the_groups(spark):
    texts = spark.createDataFrame([(1, "Red red  blue"), (2, "green"), (3, ""), (4, "blue x y z"), (5, "RED")], "item int, t string")
    groups = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 1), (2, 4), (3, 3), (4, 5)], "g int, item int")
    want = rows(S.group_bm25(groups.join(texts, "item"), "g", "item", "t", "red Blue red"))
    assert rows(S.group_bm25(groups, "g", "item", "t", "red Blue red", texts=texts)) == want and len(want) == 4
