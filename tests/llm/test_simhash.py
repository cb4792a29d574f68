"""SimHash near-dedup against brute force."""

import numpy as np
import xxhash

from graphloom.llm import simhash
from graphloom.llm.common import connected_components

SF = "/root/testdata/sf0.001"


def slow_print(text):
    words = (text or "").encode().lower().split()
    runs = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_groups(codes, most=3):
    codes = sorted(set(codes))
    group = {c: c for c in codes}
    for i, a in enumerate(codes):
        for b in codes[i + 1 :]:
            if (a ^ b).bit_count() <= most and group[a] != group[b]:
                low, high = sorted((group[a], group[b]))
                group = {c: low if g == high else g for c, g in group.items()}
    return group


def test_contract_rows(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    prints = {i: slow_print(t) for i, t in docs.items()}
    group = slow_groups(prints.values())
    least = {}
    for i, p in prints.items():
        least[group[p]] = min(i, least.get(group[p], i))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op7_simhash_near_dedup(spark, SF).collect()}
    assert got == {i: (f"{p:016x}", least[group[p]]) for i, p in prints.items()}


def test_links_by_any_dealing(spark):
    random = np.random.default_rng(1)
    codes = set(map(int, random.integers(0, 2**64, 200, dtype=np.uint64)))
    for x in list(codes)[:40]:
        for _ in range(15):
            for k in random.integers(0, 64, random.integers(1, 4)):
                x ^= 1 << int(k)
            codes.add(x)
    want = {}
    for c, g in slow_groups(codes).items():
        want.setdefault(g, set()).add(c)
    rows = spark.createDataFrame([(c - 2**64 if c >= 2**63 else c,) for c in codes], "code long")
    for hot, bucket in ((2, 1000), (20_000, 1000), (20_000, 1), (60, 64)):
        got = {}
        for r in connected_components(simhash.links(rows, 3, hot, bucket)).collect():
            got.setdefault(r.component, set()).add(r.node % 2**64)
        assert sorted(map(sorted, got.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)


def test_odd_rows(spark, odd_docs, no_docs):
    got = simhash.simhash_components(odd_docs).collect()
    assert len(got) == odd_docs.count()
    empty = {r.component_id for r in got if r.fingerprint == 0}
    assert len(empty) == 1
    assert simhash.simhash_components(no_docs).count() == 0
    kept = simhash.keep_one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    rows = [(r.doc_id, r.text) for r in kept.collect() if r.doc_id is not None]
    ids = {i for i, _ in rows}
    assert len(rows) == len(set(rows)) and 0 in ids and 1 not in ids


def test_different_texts_of_one_id_both_stay(spark):
    texts = [(1, "alpha beta gamma"), (1, "a quite different text here"), (1, "alpha beta gamma"), (2, "alpha beta gamma"), (3, "a third one of its own")]
    for rows in (texts, texts[::-1]):
        kept = simhash.keep_one_of_each(spark.createDataFrame(rows, "doc_id int, text string"))
        assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted({texts[0], texts[1], texts[4]})


def test_components_of_stars_and_chains(spark):
    edges = [(0, i) for i in range(1, 300)] + [(1000 + i, 1001 + i) for i in range(90)] + [(5, 5), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {got[i] for i in range(300)} == {0} and {got[1000 + i] for i in range(91)} == {1000}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_long_texts_in_parts(monkeypatch):
    texts = [" ".join(f"w{k * k % 83}" for k in range(n)) for n in (0, 1, 2, 3, 40, 3000)]
    want = [slow_print(t) for t in texts]
    monkeypatch.setattr(simhash, "HELD_BYTES", 50)
    monkeypatch.setattr(simhash, "HELD_SHINGLES", 20)
    assert [int(x) % 2**64 for x in simhash.fingerprints_of([t.encode() for t in texts])] == want
