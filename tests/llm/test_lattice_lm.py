"""Lattice scores against a plain recursion."""

import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from graphloom.llm import lattice_lm as L
from graphloom.llm import vocabulary


def test_marginals_like_a_plain_recursion():
    vocab = vocabulary.load()
    lattice = L.Lattice(vocab)
    weights = lattice.first_weights(vocab)
    assert abs(np.exp(weights).sum() - 1) < 1e-9
    ids = {}
    for i in vocab.normal.tolist():
        ids.setdefault(vocab.surfaces[i], []).append(i)

    def plain(word):
        s = b" " + word
        a = [0.0] + [-math.inf] * len(s)
        for i in range(len(s)):
            a[i + 1] = np.logaddexp(a[i + 1], a[i] + weights[vocab.byte_ids[s[i]]])
            for j in range(i + 1, min(len(s), i + 48) + 1):
                for p in ids.get(s[i:j], []):
                    a[j] = np.logaddexp(a[j], a[i] + weights[p])
        return a[-1]

    words = [b"the", b"", b"a", "é漢字".encode(), b"thblehe", b"x" * 70, bytes([0, 255, 3]), b"international" * 10, *(bytes([97 + k]) * k for k in range(26))]
    assert np.abs(lattice.log_marginals(words, weights) - [plain(w) for w in words]).max() < 1e-9
    expected = np.zeros(lattice.size)
    lattice.log_marginals([b"ab"], weights, np.ones(1), expected)
    lens = np.array([max(1, len(s)) for s in vocab.surfaces] + [0])
    assert abs((expected * lens).sum() - 3) < 1e-9  # the expected pieces cover the word and its mark once


def check_base(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter()
    for i, t in rows:
        if not held(i):
            counts.update((t or "").encode().lower().split() + [None])
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, t in rows:
        tokens = (t or "").encode().lower().split() + [None]
        want.append((str(i), held(i), len(tokens), sum(x in counts for x in tokens), round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in tokens), 6)))
    scores = []
    for head in (100_000, 3, 0):
        got = L.score(docs, L.is_held_out(F.col("doc_id"), 7, 2), rounds=1, head_words=head).collect()
        assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == sorted(want)
        assert all(r.train_tokens == n and r.score < 0 and math.isfinite(r.score) for r in got)
        scores.append(sorted((str(r.doc_id), round(r.score, 6)) for r in got))
    assert scores[0] == scores[1] == scores[2]


def segmentations(word, pieces):
    """All ways to cut a word, each as the list of its pieces."""
    if not word:
        yield []
    for k in range(1, len(word) + 1):
        for p in pieces.get(word[:k], []):
            for rest in segmentations(word[k:], pieces):
                yield [p, *rest]


def test_score_by_listing_all_segmentations(spark):
    """Fitting and scoring as two rounds by hand over every segmentation of every word."""
    texts = {1: "the cat the", 2: "a Cat", 3: None, 4: "dog cat zq"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id int, text string")
    vocab = vocabulary.load()
    lattice = L.Lattice(vocab)
    pieces = {}
    for i in vocab.normal.tolist():
        pieces.setdefault(vocab.surfaces[i], []).append(i)
    for byte in range(256):
        pieces.setdefault(bytes([byte]), []).append(int(vocab.byte_ids[byte]))
    words = {i: (t or "").lower().encode().split() for i, t in texts.items()}
    ways = {w: list(segmentations(b" " + w, pieces)) for ws in words.values() for w in ws}
    first = np.exp(lattice.first_weights(vocab))
    chance = first
    for _ in range(2):
        counts = first * 0.01 * lattice.size
        for i in (1, 2, 3):
            counts[-1] += 1
            for w in words[i]:
                each = np.array([np.prod([chance[p] for p in way]) for way in ways[w]])
                for way, share in zip(ways[w], each / each.sum(), strict=True):
                    for p in way:
                        counts[p] += share
        chance = counts / counts.sum()

    def logs(i, p):
        return math.log10(p[-1]) + sum(math.log10(sum(np.prod([p[x] for x in way]) for way in ways[w])) for w in words[i])

    got = {r.doc_id: r for r in L.score(docs, F.col("doc_id") == 4, rounds=2).collect()}
    for i in texts:
        assert abs(got[i].score - logs(i, chance)) < 1e-9 and abs(got[i].vocabulary_score - logs(i, first)) < 1e-9


def test_long_words_in_parts(monkeypatch):
    vocab = vocabulary.load()
    lattice = L.Lattice(vocab)
    weights = lattice.first_weights(vocab)
    words = [bytes(97 + (k * k + k // 7) % 26 for k in range(5000)), b"short", b"y" * 900]
    want, expected = lattice.log_marginals(words, weights), np.zeros(lattice.size)
    lattice.log_marginals(words, weights, np.array([1.0, 3.0, 2.0]), expected)
    monkeypatch.setattr(L, "LATTICE_BYTES", 700)
    again = np.zeros(lattice.size)
    assert np.abs(lattice.log_marginals(words, weights, np.array([1.0, 3.0, 2.0]), again) - want).max() < 1e-6
    assert np.abs(again - expected).max() < 1e-6


def test_odd_rows(spark, odd_docs, no_docs):
    check_base(spark, odd_docs)
    assert L.score(no_docs, F.lit(False), rounds=1).count() == 0


def test_all_held_out(spark):
    docs = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id int, text string")
    got = {r.doc_id: r for r in L.score(docs, F.lit(True), rounds=2).collect()}
    assert got[1].n_known == 0 and got[1].train_tokens == 0 and got[1].base_score == 0 and got[1].score < got[2].score < 0


def test_known_text_scores_above_noise(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    noise = docs.where("doc_id < 20").select((F.col("doc_id") + 10_000).alias("doc_id"), F.reverse("text").alias("text"))
    got = L.score(docs.union(noise), F.col("doc_id") >= 10_000)
    mean = {r.h: r.s for r in got.groupBy((F.col("doc_id") >= 10_000).alias("h")).agg((F.sum("score") / F.sum("n_tokens")).alias("s")).collect()}
    assert mean[False] > mean[True] + 1
