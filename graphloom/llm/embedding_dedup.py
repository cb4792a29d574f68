"""Embedding near-dedup over hierarchical navigable small-world graphs.

Distinct vectors of a label are dealt to shards of bounded size. Each shard has a graph of its own: layers of fewer and
fewer nodes, whose neighbours are chosen to lie in different directions, built by inserting growing blocks of nodes. When
it is built its beams are widened until audits pass: probes made at the limit of similarity must find the vectors they were
made from, as vectors of other shards must, and a share of the vectors must find what brute force finds. A shard that never
passes is compared in full, and so is a vector with more neighbours in range than a beam holds. Blocks of query vectors
travel to the graph of each shard of their label and stream past it; of two shards one queries the other. Links are
verified in double precision, counted and joined to local components as they are found, and components of shards are joined
by a distributed search.
"""

from __future__ import annotations

import itertools
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import Forest, connected_components, stored

SHARD_ROWS, NEIGHBOURS, LAYER_SHARE, BEAM = 20_000, 16, 16, 48
#: Share of probes and of brute-force links that a beam must find, probes of a shard, ids of which one in so many is audited.
RECALL, PROBES, AUDITED = 0.995, 256, 50
#: Queries that walk together, beams over which a query with all its beam in range is compared in full, queries of other shards in a task.
BLOCK, WIDEST, QUERY_ROWS = 512, 192, 100_000
#: Similarities in single precision may be so far below the true ones; pairs that are verified together.
MARGIN, AT_ONCE = 1e-5, 100_000


class Layer:
    """A graph over some nodes of a shard, by their positions in the shard's vectors."""

    def __init__(self, width: int, size: int) -> None:
        self.near = np.full((size, width), -1, np.int32)

    def connect(self, x: np.ndarray, nodes: np.ndarray, found: np.ndarray) -> None:
        """Gives `nodes` chosen neighbours among `found` (padded by -1), and those a link back."""
        width = self.near.shape[1]
        self._put(nodes, chosen(x, nodes, found, width // 2))
        ends, starts = self.near[nodes].ravel(), np.repeat(nodes, width)
        keep = ends >= 0
        ends, starts = ends[keep], starts[keep]
        order = np.argsort(ends, kind="stable")
        ends, starts = ends[order], starts[order]
        targets, first, n = np.unique(ends, return_index=True, return_counts=True)
        most = min(int(n.max()), 4 * width) if len(n) else 0
        rank = np.arange(len(ends)) - np.repeat(first, n)
        fresh = np.full((len(targets), most), -1, np.int32)
        some = rank < most
        fresh[np.repeat(np.arange(len(targets)), n)[some], rank[some]] = starts[some]
        joined = np.concatenate((self.near[targets], fresh), axis=1)
        free = (joined >= 0).sum(axis=1) <= width
        packed = np.take_along_axis(joined, np.argsort(joined < 0, axis=1, kind="stable"), 1)[:, :width]
        self._put(targets[free], packed[free])
        full = np.flatnonzero(~free)
        for k in range(0, len(full), BLOCK):
            part = full[k : k + BLOCK]
            self._put(targets[part], chosen(x, targets[part], joined[part], width))

    def _put(self, nodes: np.ndarray, neighbours: np.ndarray) -> None:
        self.near[nodes, : neighbours.shape[1]] = neighbours
        self.near[nodes, neighbours.shape[1] :] = -1


def chosen(x: np.ndarray, nodes: np.ndarray, found: np.ndarray, most: int) -> np.ndarray:
    """Up to `most` of the `found` nodes, nearest first, each nearer to its node than to those chosen before; then the nearest of the rest."""
    sims = np.einsum("ijk,ik->ij", x[found], x[nodes])
    sims[(found < 0) | (found == nodes[:, None])] = -np.inf
    order = np.argsort(-sims, axis=1)[:, : 4 * most]
    found, sims = np.take_along_axis(found, order, 1), np.take_along_axis(sims, order, 1)
    taken = np.zeros(found.shape, bool)
    closest = np.full(found.shape, -np.inf)  # to any node chosen before
    for k in range(found.shape[1]):
        take = (sims[:, k] > closest[:, k]) & np.isfinite(sims[:, k]) & (taken.sum(axis=1) < most)
        taken[take, k] = True
        rows = np.flatnonzero(take)
        if len(rows) and k + 1 < found.shape[1]:
            closest[rows, k + 1 :] = np.maximum(closest[rows, k + 1 :], np.einsum("ijk,ik->ij", x[found[rows, k + 1 :]], x[found[rows, k]]))
    rank = np.argsort(np.where(taken, 0, np.where(np.isfinite(sims), 1, 2)), axis=1, kind="stable")[:, :most]
    return np.take_along_axis(np.where(np.isfinite(sims), found, -1), rank, 1)


def beam(x: np.ndarray, near: np.ndarray, queries: np.ndarray, entries: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, similarities) of the `size` best nodes that a best-first walk from `entries` finds for each query."""
    q, step = len(queries), max(2, size // 16)
    seen = np.zeros((q, len(x)), bool)
    size = min(size, len(x))
    nodes = np.full((q, size + entries.shape[1]), -1, np.int32)
    sims = np.full(nodes.shape, -np.inf, np.float32)
    done = np.ones(nodes.shape, bool)
    e = entries.shape[1]
    nodes[:, :e] = entries
    known = entries >= 0
    sims[:, :e] = np.where(known, np.einsum("ijk,ik->ij", x[entries], queries), -np.inf)
    done[:, :e] = ~known
    np.put_along_axis(seen, np.maximum(entries, 0), True, 1)
    nodes, sims, done = _best(nodes, sims, done, size)
    active = np.arange(q)
    while len(active):
        open_ = np.where(done[active], -np.inf, sims[active])
        active = active[np.isfinite(open_).any(axis=1)]
        if not len(active):
            break
        open_ = np.where(done[active], -np.inf, sims[active])
        some = min(step, open_.shape[1])
        pick = np.argpartition(-open_, some - 1, axis=1)[:, :some]
        real = np.isfinite(np.take_along_axis(open_, pick, 1))
        rows = np.repeat(active[:, None], some, 1)
        done[rows, pick] = True
        ahead = np.where(real[:, :, None], near[nodes[rows, pick]], -1).reshape(len(active), -1)
        at, col = np.nonzero((ahead >= 0) & ~seen[active[:, None], np.maximum(ahead, 0)])
        node = ahead[at, col]
        key = np.unique(at.astype(np.int64) * len(x) + node)
        at, node = key // len(x), (key % len(x)).astype(np.int32)
        if not len(at):
            continue
        seen[active[at], node] = True
        sim = np.einsum("ij,ij->i", x[node], queries[active[at]])
        n = np.bincount(at, minlength=len(active))
        place = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        fresh, fresh_sims = np.full((len(active), n.max()), -1, np.int32), np.full((len(active), n.max()), -np.inf, np.float32)
        fresh[at, place], fresh_sims[at, place] = node, sim
        merged = _best(np.concatenate((nodes[active], fresh), 1), np.concatenate((sims[active], fresh_sims), 1), np.concatenate((done[active], fresh < 0), 1), size)
        nodes[active], sims[active], done[active] = merged
    return nodes, sims


def _best(nodes: np.ndarray, sims: np.ndarray, done: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    if nodes.shape[1] <= size:
        return nodes, sims, done
    keep = np.argpartition(-sims, size - 1, axis=1)[:, :size]
    return tuple(np.take_along_axis(a, keep, 1) for a in (nodes, sims, done))


class Graph:
    """A shard's layers over unit vectors in single precision."""

    def __init__(self, x: np.ndarray, seed: int = 4) -> None:
        self.x, self.layers = x, []
        n, random = len(x), np.random.default_rng(seed)
        order = random.permutation(n).astype(np.int32)
        size, counts = n, [n]
        while size > 4 * LAYER_SHARE:
            size //= LAYER_SHARE
            counts.append(size)
        for count in reversed(counts):  # a layer's nodes come first in the one below
            layer = Layer(2 * NEIGHBOURS, n)
            at = min(count, 256)
            first = order[:at]
            sims = x[first] @ x[first].T
            np.fill_diagonal(sims, -np.inf)
            layer.connect(x, first, first[np.argsort(-sims, axis=1)[:, : 4 * NEIGHBOURS]])
            while at < count:
                block = order[at : min(count, at + min(at, BLOCK))]
                found, _ = beam(x, layer.near, x[block], self._enter(x[block], order[:1]), BEAM)
                sims = x[block] @ x[block].T
                np.fill_diagonal(sims, -np.inf)
                own = block[np.argsort(-sims, axis=1)[:, :NEIGHBOURS]]
                layer.connect(x, block, np.concatenate((found, own), axis=1))
                at += len(block)
            self.layers.append(layer.near)

    def _enter(self, queries: np.ndarray, start: np.ndarray, width: int = 4) -> np.ndarray:
        """Nodes near the queries by the layers that there are, for the next one."""
        entries = np.repeat(start[None, :], len(queries), 0)
        for near in self.layers:
            entries, _ = beam(self.x, near, queries, entries, width)
        return entries

    def search(self, queries: np.ndarray, size: int, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lowest = self.layers.pop()
        try:
            entries = self._enter(queries, start)
        finally:
            self.layers.append(lowest)
        return beam(self.x, lowest, queries, entries, size)


def in_range(graph: Graph, queries: np.ndarray, limit: float, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(query, node, in full) with similarity of `limit` or more.

    Beams that end within the range are widened, and beyond `WIDEST` the query is compared with all nodes; a size of 0
    does so at once. `in full` says which.
    """
    start = _top(graph)
    todo = np.arange(len(queries))
    while size and len(todo) and size <= WIDEST:
        again = []
        for k in range(0, len(todo), BLOCK):
            part = todo[k : k + BLOCK]
            nodes, sims = graph.search(queries[part], size, start)
            full = sims.min(axis=1) >= limit
            again.append(part[full])
            row, col = np.nonzero((sims >= limit) & ~full[:, None] & (nodes >= 0))
            yield part[row], nodes[row, col], False
        todo, size = np.concatenate(again), size * 4
    for k in range(0, len(todo), BLOCK):
        part = todo[k : k + BLOCK]
        row, node = np.nonzero(queries[part] @ graph.x.T >= limit)
        yield part[row], node.astype(np.int32), True


def _top(graph: Graph) -> np.ndarray:
    return np.flatnonzero((graph.layers[0] >= 0).any(axis=1))[:1].astype(np.int32) if len(graph.x) > 1 else np.zeros(1, np.int32)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at unit length; scaled by their largest component first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def audited_beam(graph: Graph, ids: np.ndarray, limit: float) -> tuple[int, float]:
    """(the first beam width, doubling from `BEAM`, whose recall passes, and that recall); (0, 1.0), all in full, if none does."""
    x, random, n = graph.x, np.random.default_rng(7), len(graph.x)
    source = random.choice(n, min(n, PROBES), replace=False)
    noise = random.normal(size=(len(source), x.shape[1]))
    noise -= (noise * x[source]).sum(axis=1, keepdims=True) * x[source]
    norm = np.sqrt((noise * noise).sum(axis=1, keepdims=True))
    aim = min(1.0, limit + 1e-4)
    probes = (aim * x[source] + np.sqrt(1 - aim**2) * noise / np.where(norm > 0, norm, 1)).astype(np.float32)
    sample = np.flatnonzero(ids % AUDITED == 0)
    size = BEAM
    while size <= WIDEST and size < n:
        found = total = 0
        for q in range(0, len(sample), BLOCK):
            truth = x[sample[q : q + BLOCK]] @ x.T >= limit
            total += int(truth.sum())
            found += sum(int(truth[a, b].sum()) for a, b, _ in in_range(graph, x[sample[q : q + BLOCK]], limit, size))
        hit = np.zeros(len(source), bool)
        for q, node, _ in in_range(graph, probes, limit, size):
            hit[q[node == source[q]]] = True
        recall = min(float(hit.mean()), found / total if total else 1.0)
        if recall >= RECALL:
            return size, recall
        size *= 2
    return 0, 1.0


def build(limit: float, table: pa.Table) -> pa.Table:
    """One row with a shard's graph and its audit, from rows (lid, lh, dim, shard, node, copies, x)."""
    node = table.column("node").to_numpy()
    order = np.argsort(node)
    x = table.column("x").combine_chunks().flatten().to_numpy().reshape(len(node), -1)[order]
    graph = Graph(unit(x).astype(np.float32))
    width, recall = audited_beam(graph, node[order], limit - MARGIN)
    blob = pickle.dumps((node[order], table.column("copies").to_numpy()[order], x, graph.layers), 5)
    keys = {name: table.column(name)[:1] for name in ("lid", "lh", "dim", "shard")}
    return pa.table(keys | {"graph": pa.array([blob], pa.large_binary() if len(blob) > 1 << 30 else pa.binary()), "width": pa.array([width], pa.int32()), "recall": pa.array([recall])})


class Target:
    """A shard's graph while queries stream past it: links are counted and joined to components of its own nodes."""

    def __init__(self, limit: float, blob: bytes, width: int, recall: float) -> None:
        self.limit, self.width, self.recall = limit, width, recall
        self.ids, self.copies, x, layers = pickle.loads(blob)
        self.x = unit(x)
        self.graph = Graph.__new__(Graph)
        self.graph.x, self.graph.layers = self.x.astype(np.float32), layers
        self.n = np.zeros(len(self.ids), np.int64)
        self.forest = Forest(len(self.ids))
        self.own = False  # whether the queries are the shard's own nodes

    def _links(self, queries: np.ndarray, only: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """Verified (query, node, in full); nodes come with the position of their own query, if any, to be left out."""
        for q, node, full in in_range(self.graph, queries.astype(np.float32), self.limit - MARGIN, self.width):
            for k in range(0, len(q), AT_ONCE):
                a, b = q[k : k + AT_ONCE], node[k : k + AT_ONCE]
                keep = np.einsum("ij,ij->i", queries[a], self.x[b]) >= self.limit
                if only is not None:
                    keep &= only[a] != b
                yield a[keep], b[keep], full

    def link_own(self) -> None:
        """Links among the shard's nodes: what a beam finds from either side counts once; a query in full has all its links."""
        size, full, pairs = len(self.ids), np.zeros(len(self.ids), bool), [np.zeros(0, np.int64)]
        some = []
        for a, b, whole in self._links(self.x, np.arange(size)):
            if whole:
                full[a] = True
                np.add.at(self.n, a, self.copies[b])
                some.append((a, b))
                if sum(len(p) for p, _ in some) > 10 * AT_ONCE:
                    self._join(some)
            else:
                pairs.append(np.unique(np.minimum(a, b).astype(np.int64) * size + np.maximum(a, b)))
        self._join(some)
        for key in np.array_split(np.unique(np.concatenate(pairs)), max(1, sum(map(len, pairs)) // AT_ONCE)):
            a, b = key // size, key % size
            np.add.at(self.n, a[~full[a]], self.copies[b[~full[a]]])
            np.add.at(self.n, b[~full[b]], self.copies[a[~full[b]]])
            self.forest.link(a, b)
        # a full query's links with nodes whose beams were not in full count for these too, unless their beams found them
        self._other_sides(full, np.unique(np.concatenate(pairs)))

    def _join(self, some: list[tuple[np.ndarray, np.ndarray]]) -> None:
        for a, b in some:
            self.forest.link(a, b)
        some.clear()

    def _other_sides(self, full: np.ndarray, known: np.ndarray) -> None:
        size, whole = len(self.ids), np.flatnonzero(full)
        for k in range(0, len(whole), BLOCK):
            part = whole[k : k + BLOCK]
            row, node = np.nonzero(self.graph.x[part] @ self.graph.x[~full].T >= self.limit - MARGIN)
            a, b = part[row], np.flatnonzero(~full)[node]
            sure = np.einsum("ij,ij->i", self.x[a], self.x[b]) >= self.limit
            a, b = a[sure], b[sure]
            key = np.minimum(a, b).astype(np.int64) * size + np.maximum(a, b)
            at = np.minimum(np.searchsorted(known, key), max(len(known) - 1, 0))
            fresh = known[at] != key if len(known) else np.ones(len(key), bool)
            np.add.at(self.n, b[fresh], self.copies[a[fresh]])

    def link_others(self, ids: np.ndarray, copies: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        """(node, n, root, recall) of those queries of another shard that have links here."""
        n, first = np.zeros(len(ids), np.int64), np.full(len(ids), -1)
        for a, b, _ in self._links(unit(x)):
            np.add.at(n, a, self.copies[b])
            np.add.at(self.n, b, copies[a])
            new = first[a] < 0
            first[a[new]] = b[new]
            self.forest.link(first[a], b)
        some = np.flatnonzero(n)
        return _rows(ids[some], n[some], self.ids[first[some]], None)

    def end(self) -> pa.RecordBatch:
        """The same of the shard's nodes: those with links, or all with the recall of its beams where its own are counted."""
        n = self.n + self.copies - 1 if self.own else self.n
        root = self.ids[self.forest.roots(np.arange(len(self.ids)))]
        some = np.arange(len(self.ids)) if self.own else np.flatnonzero(n)
        return _rows(self.ids[some], n[some], root[some], self.recall if self.own else None)


def _rows(node: np.ndarray, n: np.ndarray, root: np.ndarray, recall: float | None) -> pa.RecordBatch:
    return pa.record_batch([pa.array(node, pa.int64()), pa.array(n.astype(np.int64)), pa.array(root, pa.int64()), pa.array([recall] * len(node), pa.float64())], ["node", "n", "root", "recall"])


def _search(limit: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Graphs, each before its queries, in rows (own, node, copies, x, graph, width, recall)."""
    target: Target | None = None
    for batch in batches:
        graphs = batch.column("graph")
        heads = [k for k in range(batch.num_rows) if graphs[k].is_valid]
        for a, b in itertools.pairwise(sorted({0, *heads, batch.num_rows})):
            if a in heads:
                if target:
                    yield target.end()
                target = Target(limit, graphs[a].as_py(), batch.column("width")[a].as_py(), batch.column("recall")[a].as_py())
                if batch.column("own")[a].as_py():
                    target.own = True
                    target.link_own()
                a += 1
            if b > a:
                part = batch.slice(a, b - a)
                x = part.column("x").flatten().to_numpy().reshape(b - a, -1)
                yield target.link_others(part.column("node").to_numpy(), part.column("copies").to_numpy(), x)
    if target:
        yield target.end()


def near_duplicates(vectors: DataFrame, limit: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(id_col, n_links, component_id, kept, recall), a row for each row of `vectors`.

    Vectors of equal labels and lengths with a cosine of `limit` or more in double precision link. Vectors that are null,
    empty, zero or hold null or non-finite components, those without a label, and those without an id link with nothing:
    n_links is 0 and component_id their id. Equal vectors count as one node with so many copies, each of which is another
    vector to the rest; rows that repeat an id are links of each other too. recall is that of the audit of the vector's
    shard, 1 where it is compared in full; null for vectors that link with nothing by themselves. An empty table gives an
    empty one. Other columns are not read.
    """
    spark = vectors.sparkSession
    x = F.col("x")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("x"))
    most = F.array_max(F.transform("x", F.abs))
    usable = F.col("id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & ~F.exists("x", lambda v: v.isNull() | F.isnan(v)) & (most > 0) & (most < float("inf"))
    rows = rows.withColumn("dim", F.size("x")).withColumn("usable", F.coalesce(usable, F.lit(False)))
    nodes = rows.where("usable").groupBy("label", "dim", "x").agg(F.min("id").alias("node"), F.count("*").alias("copies"))
    nodes = stored(nodes, "vectors")
    sizes = nodes.groupBy("label", "dim").agg(F.min("node").alias("lid"), F.ceil(F.count("*") / shard_rows).cast("int").alias("shards"), F.ceil(F.count("*") / (2 * query_rows)).cast("int").alias("blocks"))
    dealt = nodes.join(sizes, ["label", "dim"]).select("lid", F.xxhash64("label").alias("lh"), "dim", F.pmod(F.xxhash64("node"), F.col("shards")).cast("int").alias("shard"), "shards", "blocks", "node", "copies", "x")
    dealt = stored(dealt, "dealt-vectors")
    keys = ["lid", "lh", "dim"]
    graphs = stored(dealt.select(*keys, "shard", "node", "copies", "x").groupBy(*keys, "shard").applyInArrow(lambda t: build(limit, t), "lid long, lh long, dim int, shard int, graph binary, width int, recall double"), "graphs")

    counts = sizes.select("lid", F.xxhash64("label").alias("lh"), "dim", "shards", "blocks")
    # a shard has one task for its own links, and others for the queries of other shards, where there are any
    tasks = graphs.join(counts, keys).withColumn("task", F.explode(F.sequence(F.lit(0), F.when(F.col("shards") > 1, F.col("blocks")).otherwise(0))))
    tasks = tasks.select(*keys, F.col("shard").alias("target"), "task", (F.col("task") == 0).alias("own"), F.lit(None).cast("long").alias("node"), F.lit(None).cast("long").alias("copies"), F.lit(None).cast("array<double>").alias("x"), "graph", "width", "recall")
    # of two shards the lower one queries the other if the sum of their numbers is even, else the higher one
    to = F.filter(F.sequence(F.lit(0), F.col("shards") - 1), lambda t: (t != F.col("shard")) & (((t + F.col("shard")) % 2 == 0) == (F.col("shard") < t)))
    queries = dealt.where("shards > 1").select(*keys, F.explode(to).alias("target"), (F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")) + 1).cast("int").alias("task"), F.lit(False).alias("own"), "node", "copies", "x", F.lit(None).cast("binary").alias("graph"), F.lit(None).cast("int").alias("width"), F.lit(None).cast("double").alias("recall"))
    groups = [*keys, "target", "task"]
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(tasks.count(), 10_000))
    placed = tasks.union(queries).repartition(n, *groups).sortWithinPartitions(*groups, F.col("graph").isNull(), "node").select("own", "node", "copies", "x", "graph", "width", "recall")
    found = stored(placed.mapInArrow(lambda batches: _search(limit, batches), "node long, n long, root long, recall double"), "vector-links")
    components = connected_components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    sums = found.groupBy("node").agg(F.sum("n").alias("n"), F.min("recall").alias("recall")).join(components, "node", "left").select("node", "n", "recall", F.coalesce("component", "node").alias("component"))
    named = nodes.select("label", "dim", "x", "node").join(sums, "node").select("label", "dim", "x", "n", "component", "recall")
    out = rows.where("usable").join(named, ["label", "dim", "x"]).select("id", "n", "component", "recall")
    out = out.union(rows.where("not usable").select("id", F.lit(0).cast("long"), "id", F.lit(None).cast("double")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_links"), F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"), "recall")


def op4_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    """The contract's rows over the whole `embeddings` table."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
