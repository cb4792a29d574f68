"""Communities by modularity against the same rounds in plain Python, and against label propagation."""

import zlib
from collections import Counter, defaultdict
from random import Random

import pytest

from graphloom.operators import components as C
from graphloom.operators import modularity as M
from graphloom.plans import catalog


def turn(index, round_, one_in):
    return zlib.crc32(f"{index}:{round_}".encode()) % one_in == 0


def settle(degree, near, community, parent, two_m, resolution, rounds, within):
    best, best_value, still, one_in = community, None, 0, 2
    for round_ in range(rounds + 1):
        total, size, inner = Counter(), Counter(), 0
        for i, c in community.items():
            total[c] += degree[i]
            size[c] += 1
        after = {}
        for i, own in community.items():
            w = Counter({own: 0})
            for j, x in near[i].items():
                if not within or parent[i] == parent[j]:
                    w[community[j]] += x
            inner += w[own]
            rows = [(-(two_m * x - resolution * degree[i] * (total[c] - (degree[i] if c == own else 0))), c != own, c) for c, x in w.items() if not (c != own and size[own] == size[c] == 1 and c > own)]
            after[i] = min(rows)[2] if turn(i, round_, one_in) else own
        value = float(two_m) * inner - resolution * sum(x * x for x in total.values())
        if best_value is not None and value < best_value:
            community, one_in, still = best, one_in * 2, 0
            continue
        best, best_value = community, value
        still = still + 1 if after == community else 0
        community = after
        if still == 2:
            break
    return best


def slow(nodes, links, resolution=1.0, rounds=10, refine_rounds=2, most_passes=3):
    near = {i: Counter() for i in nodes}
    for a, b in links:
        if a != b and a in near and b in near:
            near[a][b] += 1
            near[b][a] += 1
    degree = {i: sum(x.values()) for i, x in near.items()}
    two_m, community, member = sum(degree.values()), {i: i for i in nodes}, {i: i for i in nodes}
    found = dict(member)
    for _ in range(most_passes if two_m else 0):
        community = settle(degree, near, community, None, two_m, resolution, rounds, False)
        found = {i: community[n] for i, n in member.items()}
        part = settle(degree, near, {i: i for i in near}, community, two_m, resolution, refine_rounds, True)
        parent = {part[i]: community[i] for i in near}
        first = defaultdict(lambda: 10**18)
        for p, c in parent.items():
            first[c] = min(first[c], p)
        smaller, sums = {p: Counter() for p in parent}, Counter()
        for i, x in near.items():
            sums[part[i]] += degree[i]
            for j, w in x.items():
                if part[i] != part[j]:
                    smaller[part[i]][part[j]] += w
        before = len(near)
        near, degree, community, member = smaller, sums, {p: first[c] for p, c in parent.items()}, {i: part[n] for i, n in member.items()}
        if len(near) == before:
            break
    names = {}
    for i, c in found.items():
        names[c] = min(names.get(c, i), i)
    return {i: names[c] for i, c in found.items()}


def quality(community, links):
    pairs = {tuple(sorted(x)) for x in links if x[0] != x[1]}
    m, inner, degree = len(pairs), Counter(), Counter()
    for a, b in pairs:
        inner[community[a]] += community[a] == community[b]
        degree[community[a]] += 1
        degree[community[b]] += 1
    return sum(inner[c] / m - (degree[c] / (2 * m)) ** 2 for c in degree)


def blocks(seed, groups=5, size=12, inside=0.5, across=0.03):
    random, n = Random(seed), groups * size
    return list(range(n)), [(a, b) for a in range(n) for b in range(a) if random.random() < (inside if a // size == b // size else across)]


@pytest.mark.parametrize("seed, resolution", [(1, 1.0), (2, 0.5)])
def test_same_as_plain_rounds(spark, seed, resolution):
    nodes, links = blocks(seed)
    nodes, links = [*nodes, 1000, 1001], [*links, links[0], (3, 3), (1, 7777), (1000, 1001)]
    n, e = spark.createDataFrame([(i,) for i in nodes], "index long"), spark.createDataFrame(links, "a long, b long")
    few = {"rounds": 5, "refine_rounds": 1, "most_passes": 2}
    got = {r["index"]: r.community for r in M.communities(n, e, resolution, **few).collect()}
    assert got == slow(nodes, links, resolution, **few)
    assert got[1000] == got[1001] == 1000


def test_finds_planted_communities():
    nodes, links = blocks(7, inside=0.7, across=0.01)
    found = slow(nodes, links, rounds=30, most_passes=4)
    assert quality(found, links) > 0.65
    assert all(found[i] // 12 == i // 12 for i in nodes)  # none reaches across two of those planted


def test_nothing(spark):
    none = spark.createDataFrame([], "a long, b long")
    assert M.communities(spark.createDataFrame([], "index long"), none).collect() == []
    assert sorted(tuple(r) for r in M.communities(spark.createDataFrame([(3,), (4,), (None,), (3,)], "index long"), none).collect()) == [(3, 3), (4, 4)]


def test_beats_label_propagation_on_the_whole_graph(spark):
    rows = {r.method: r for r in catalog.queries()["communities_modularity"](spark, "/root/testdata/sf0.001").collect()}
    assert rows["modularity"].modularity > rows["label propagation"].modularity + 0.05


def test_a_round_deals_links_once_by_the_end_that_sums_up(spark):
    """The links lie by their end b; nodes come to them, and only one exchange in a round takes links to their end a."""
    n, e = spark.createDataFrame([(i,) for i in range(4)], "index long"), spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "a long, b long")
    now, edges = M.graph(n, e)
    assert edges.rows.count() == 6
    step = M.moved(now, edges, 6, 1.0, 0, 2)
    assert {r["index"] for r in step.collect()} == {0, 1, 2, 3}
    plan = step._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression [a#") == 1
    assert M.value(now, edges, 6, 1.0) == -(1 + 4 + 4 + 1)
    edges.free()
