"""The quality classifier by held-out accuracy."""

import re
import zlib

import numpy as np
import pyarrow as pa

from graphloom.llm import quality

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = quality.op10_quality_classifier(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in held) >= 0.97 * len(held)
    loss = sum((r.score - labels[r.doc_id]) ** 2 for r in held) / len(held)
    assert loss < 0.03  # calibrated probabilities, not only a right order


def test_odd_rows_and_few_labels(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (2, None), (3, 0), (None, 1), (3, 1)], "doc_id long, quality int")
    got = quality.with_quality(odd_docs, labels)
    rows = got.collect()
    # two labelled documents are too few for a network: all rows, null and empty texts too, get the smoothed share of label 1
    assert len(rows) == odd_docs.count() and got.columns == odd_docs.columns and {round(r.score, 6) for r in rows} == {0.5}
    assert all(np.isfinite(r.score) for r in rows)
    assert quality.with_quality(no_docs, labels).count() == 0
    assert quality.keep_good(odd_docs, labels.where("false"), 0.4).columns == odd_docs.columns


def test_same_result_each_time(spark):
    first, second = (sorted((r.doc_id, r.score) for r in quality.op10_quality_classifier(spark, "/root/testdata/sf0.001").collect()) for _ in range(2))
    assert first == second


def test_vectors_like_a_plain_loop(spark, odd_docs):
    texts = [r.text for r in odd_docs.select("text").collect()] + ["Ein Wort, ein WORT!! ***", "wort ÉTÉ été"]
    index = quality.index_vectors().astype(int)
    sums = np.zeros(index.shape, int)
    found = []
    for text in texts:
        tokens = [zlib.crc32(t) % quality.TABLE for t in re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x00-\x20]+", (text or "").encode())]
        found.append(tokens)
        for k, t in enumerate(tokens):
            for j in (k - 1, k + 1):
                if 0 <= j < len(tokens):
                    sums[t] += index[tokens[j]]
    want = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-6)
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    got = quality.word_vectors(docs)
    assert np.allclose(got, want, atol=1e-6)
    pooled = quality.Pooler(got).pool(pa.array(texts, pa.string()))
    assert np.allclose(pooled, [want[t].mean(axis=0) if t else np.zeros(quality.DIM) for t in found], atol=1e-5)


def test_long_texts_are_cut_at_blanks(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(3000))
    whole = quality.Slots().of(text.encode())
    monkeypatch.setattr(quality, "HELD_BYTES", 1000)
    assert (quality.Slots().of(text.encode()) == whole).all()


def test_vectors_do_not_depend_on_batches(spark, monkeypatch):
    texts = pa.array([r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()] + [None, ""])
    random = np.random.default_rng(1).normal(size=(quality.TABLE, quality.DIM))
    pooler = quality.Pooler(quality.rounded(random / np.linalg.norm(random, axis=1, keepdims=True)))
    whole = pooler.pool(texts)
    monkeypatch.setattr(quality, "HELD_TOKENS", 700)  # long texts are summed in several steps
    parts = [pooler.pool(texts[k : k + 7]) for k in range(0, len(texts), 7)]
    assert (np.concatenate(parts) == whole).all()
