"""The block-max index against all cosines, odd rows, and accuracy on documents held out."""

import zlib
from collections import Counter
from random import Random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import toxicity as T

SF = "/root/testdata/sf0.1"


def random_rows(n, n_terms, seed):
    random = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        own = np.unique(np.minimum(random.zipf(1.3, random.integers(0, 30)) + (k % 4) * 20, n_terms) - 1)
        w = random.random(len(own)) + 0.01
        rows.append((own.astype(np.int64), w / max(1e-12, np.linalg.norm(w))))
    return rows


@pytest.mark.parametrize("n, block, k", [(0, 8, 3), (1, 8, 3), (7, 8, 3), (300, 8, 5), (300, 16, 40), (300, 16, 300), (301, 4, 1)])
def test_nearest_are_exact(n, block, k):
    rows = random_rows(n, 90, n + k)
    rows += rows[: n // 5]  # ties
    index = T.BlockMaxIndex(rows, 90, block)
    dense = np.zeros((len(rows), 90))
    for i, (t, w) in enumerate(rows):
        dense[i, t] = w
    for t, w in random_rows(60, 90, 1):
        q = np.zeros(90)
        q[t] = w
        cosines = np.round(dense @ q, 9)
        want = [i for i in np.lexsort((np.arange(len(rows)), -cosines))[:k] if cosines[i] > 0]
        found, got = index.nearest(t, w, k)
        assert np.allclose(np.sort(cosines[want])[::-1], got) and (len(set(found)) == len(found))
        # the same examples, but for those that tie in last place
        last = cosines[want[-1]] if want else 0
        assert {i for i in want if cosines[i] > last} <= set(found.tolist())
    if n == 300 and k == 5:
        assert index.read < 0.9 * index.asked  # blocks are left out


def test_terms_of_a_long_text(monkeypatch):
    text = "Abc dé.f 12-ABC " * 50
    whole = T.terms_of(text.encode())
    assert whole == Counter({b"abc": 100, "dé".encode(): 50, b"f": 50, b"12": 50})
    monkeypatch.setattr(T, "HELD_BYTES", 7)
    assert T.terms_of(text.encode()) == whole


def made(n=400):
    random = Random(5)
    words, bad = [f"w{k}" for k in range(200)], ["ugly", "vile", "nasty"]
    rows = []
    for i in range(n):
        toxic = i % 5 == 0
        text = random.choices(words, k=random.randrange(8, 40)) + (random.choices(bad, k=4) if toxic else [])
        random.shuffle(text)
        rows.append((i, " ".join(text), int(toxic)))
    return rows


def test_scores_and_evidence(spark, odd_docs):
    rows = made()
    docs = spark.createDataFrame([(i, t, 7.0, "e", "r") for i, t, _ in rows], "doc_id long, text string, score double, evidence string, _x string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(5, None), (10**9, 1), (None, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in T.with_toxicity(docs, labels).collect()}
    out = {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    right = [(got[i].score >= 0.5) == (y == 1) for i, _, y in rows if i in out]
    assert len(right) > 50 and np.mean(right) > 0.95
    assert set(docs.columns) == set(got[0].asDict())
    held = [r for i, r in got.items() if i in out]
    assert all(0 <= r.score <= 1 and len(r.evidence) == 5 and all(int(e.id) not in out for e in r.evidence) for r in held)
    # an example is its own nearest; all toxic documents but those held out are examples
    assert all(r.evidence[0].id == str(i) and abs(r.evidence[0].cosine - 1) < 1e-9 for i, r in got.items() if i not in out and i % 5 == 0)
    # labels of the fold that is held out change nothing
    other = labels.withColumn("toxic", F.when(T.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: r.score for r in T.with_toxicity(docs, other).collect()}
    assert all(abs(again[i] - r.score) < 1e-12 for i, r in got.items())
    odd = T.with_toxicity(docs.select("doc_id", "text").union(odd_docs.select("doc_id", "text")), labels).where("text is null or trim(text) = ''").collect()
    assert len(odd) >= 3 and all(0 < r.score < 1 for r in odd) and len({r.score for r in odd}) == 1


def test_few_or_no_labels(spark, no_docs, odd_docs):
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    assert T.with_toxicity(no_docs, empty).count() == 0
    assert {r.score for r in T.with_toxicity(odd_docs, empty).collect()} == {0.5}
    one = spark.createDataFrame([(k, 0) for k in range(40)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(k, f"word{k} text") for k in range(60)], "doc_id long, text string")
    assert all(r.score < 0.1 for r in T.with_toxicity(docs, one).collect())


def test_bounds_of_the_sample(spark):
    rows = made(200)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = T.fit(docs, labels, F.lit(True), sample=30)
    assert Counter(model.labels.tolist()) == {0.0: 30, 1.0: 30}
    small = T.fit(docs, labels, F.lit(True), sample_bytes=4000)
    assert 10 < len(small.labels) < 60


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    found = T.op13_toxicity(spark, SF)
    assert found.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    rows = found.join(labels, "doc_id").where("held_out").select("score", "predicted", "toxic").collect()
    assert len(rows) > 700 and found.count() == docs.count()
    assert np.mean([r.predicted == r.toxic for r in rows]) > 0.94
    assert np.mean([r.predicted for r in rows if not r.toxic]) < 0.02
    assert abs(np.mean([r.score for r in rows]) - np.mean([r.toxic for r in rows])) < 0.03
