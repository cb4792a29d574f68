"""Embedding near-dedup against brute force."""

import numpy as np
import pytest

from graphloom.llm import embedding_dedup as E


def slow(rows, limit=0.98):
    usable = {i: (lab, np.array(v, float) / np.abs(v).max()) for i, lab, v in rows if i is not None and lab is not None and v and all(c is not None and np.isfinite(c) for c in v) and np.any(v)}
    ids = sorted(usable)
    group, n = {i: i for i in usable}, dict.fromkeys(usable, 0)
    for a in ids:
        for b in ids:
            (la, x), (lb, y) = usable[a], usable[b]
            if a < b and la == lb and len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= limit:
                n[a] += 1
                n[b] += 1
                low, high = sorted((group[a], group[b]))
                group = {k: low if g == high else g for k, g in group.items()}
    return {i: (n[i], group[i], group[i] == i) for i in ids}


def data():
    random = np.random.default_rng(3)
    rows = []
    for label in (0, 1):
        base = random.normal(size=(150, 16))
        for v in base:
            rows.append((len(rows), label, v.tolist()))
        for v in base[:20]:
            for _ in range(4):
                rows.append((len(rows), label, (2 * v + random.normal(size=16) * 0.2).tolist()))
        rows.append((len(rows), label, base[0].tolist()))
    return rows


@pytest.mark.parametrize(("shard_rows", "query_rows"), [(6000, 6000), (60, 6000), (50, 40)])
def test_like_brute_force(spark, shard_rows, query_rows):
    rows = data()
    rows += [(8001, 0, (np.array(rows[0][2]) * 1e200).tolist()), (8002, 0, (np.array(rows[0][2]) * 1e-200).tolist())]
    odd = [(9001, 0, None), (9002, 0, []), (9003, 0, [0.0] * 16), (9004, 0, [float("nan")] + [1.0] * 15), (9005, None, rows[0][2]), (9006, 0, [None] + [1.0] * 15), (9007, 0, [float("inf")] + [1.0] * 15), (9008, 0, [1.0, 2.0]), (9009, 0, [1.0, 2.0]), (None, 0, rows[0][2])]
    df = spark.createDataFrame(rows + odd, "vec_id long, label int, embedding array<double>").selectExpr("*", "1 as id", "2 as x", "3 as node", "4 as copies", "5 as shard")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in E.near_duplicates(df, shard_rows=shard_rows, query_rows=query_rows).collect()}
    want = slow(rows + odd)
    assert {i: got[i] for i in want} == want
    assert all(got[i][:2] == (0, i) for i in (9001, 9002, 9003, 9004, 9005, 9006, 9007))
    assert len(got) == len(rows + odd)


def test_a_shard_that_never_passes_is_compared_in_full(spark, monkeypatch):
    random = np.random.default_rng(8)
    x = E.unit(random.normal(size=(400, 8))).astype(np.float32)
    graph = E.Graph(x)
    monkeypatch.setattr(E, "RECALL", 1.1)
    assert E.audited_beam(graph, np.arange(400), 0.98) == (0, 1.0)
    found = {(int(a), int(b)) for q, n, full in E.in_range(graph, x, 0.8, 0) for a, b in zip(q, n, strict=True) if full}
    assert found == set(zip(*map(np.ndarray.tolist, np.nonzero(x @ x.T >= 0.8)), strict=True))


def test_empty(spark):
    assert E.near_duplicates(spark.createDataFrame([], "vec_id long, label int, embedding array<float>")).count() == 0


def test_a_large_group_of_near_copies(spark):
    random = np.random.default_rng(5)
    v = random.normal(size=24)
    rows = [(i, 1, (v + random.normal(size=24) * 0.02).tolist()) for i in range(700)] + [(1000 + i, 1, random.normal(size=24).tolist()) for i in range(300)]
    got = E.near_duplicates(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"))
    assert got.where("vec_id < 700 and n_links = 699 and component_id = 0").count() == 700
    assert all(r.recall >= E.RECALL for r in got.collect())


def test_beams_are_widened_until_probes_are_found():
    random = np.random.default_rng(6)
    x = E.unit(random.normal(size=(1500, 32))).astype(np.float32)
    graph = E.Graph(x)
    size, recall = E.audited_beam(graph, np.arange(1500), 0.98)
    assert size and recall >= E.RECALL
    sample = np.arange(0, 1500, 50)
    found, _ = graph.search(x[sample], size, E._top(graph))
    assert (found == sample[:, None]).any(axis=1).mean() >= 0.99
