"""Toxicity from the nearest labelled examples.

A bounded sample of labelled documents is held as an inverted index: for each term the examples that hold it, with the term's
weight in their vector, in blocks of examples that are alike, and for each block the largest weight in it. A document asks
for its nearest examples by TF-IDF cosine. Its terms' block maxima bound the cosine of every example of a block; blocks are
read from the highest bound down, and one whose bound is below the last of the nearest found so far is left out, so the
nearest are exact. They vote with their cosine, and a logistic curve fitted to the votes that the examples get from each
other turns votes into probabilities. The nearest examples are returned as evidence. How many documents hold a term is
counted over all documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import pieces_of, small_batches, stored, texts_as_bytes

#: Bounds of what the fit reads: labelled documents of each class, and bytes of text of all of them.
SAMPLE_DOCS, SAMPLE_BYTES = 2000, 64 << 20
#: Examples of a block; share of the examples that hold a term of the index, and their least number.
BLOCK, LEAST_SHARE, LEAST_DOCS = 64, 0.01, 2
#: A term that one in so many examples hold is read without lists.
OFTEN = 8
#: Nearest examples that vote: one in so many of the examples, within limits; and those that are named as evidence.
ONE_IN, FEWEST, MOST, EVIDENCE = 30, 15, 95, 5
THRESHOLD = 0.5
#: Bytes of text that are split at once.
HELD_BYTES = 1_000_000

_TERM, _BREAK = re.compile(rb"[0-9a-z\x80-\xff]+"), re.compile(rb"[^0-9a-z\x80-\xff]")
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def terms_of(text: bytes) -> Counter:
    """Terms of a whole text with their numbers; a long text is cut between terms to be read."""
    out, text, at = Counter(), text.translate(_LOWER), 0
    while at < len(text):
        end = _BREAK.search(text, at + HELD_BYTES) if len(text) - at > HELD_BYTES else None
        upto = end.start() if end else len(text)
        out.update(_TERM.findall(text, at, upto))
        at = upto
    return out


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[Counter]]:
    for batch in batches:
        for rows in pieces_of(batch, HELD_BYTES):
            yield [terms_of(x) for x in texts_as_bytes(rows.column("text"))]


class Vectors:
    """TF-IDF vectors over the terms of an index: (1 + ln tf) times the squared logarithm of the inverse share of documents."""

    def __init__(self, terms: list[bytes], found_in: np.ndarray, n_docs: int) -> None:
        self.numbers = {t: i for i, t in enumerate(terms)}
        self.idf = np.log((n_docs + 1) / (np.minimum(found_in, n_docs) + 1)) ** 2

    def of(self, terms: Counter) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, weights) of the known terms, ascending, at unit length."""
        numbers = self.numbers
        known = sorted((numbers[t], n) for t, n in terms.items() if t in numbers)
        at = np.array([i for i, _ in known], np.int64)
        weights = self.idf[at] * (1 + np.log(np.array([n for _, n in known], float)))
        some = weights > 0
        return at[some], weights[some] / max(1e-12, float(np.linalg.norm(weights)))


class BlockMaxIndex:
    """Vectors of examples by term, in blocks, with the largest weight of each term in each block."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], n_terms: int, block: int = BLOCK) -> None:
        self.n, self.block = len(rows), block
        self.order = _alike(rows, n_terms, block)
        place = np.empty(self.n, np.int64)
        place[self.order] = np.arange(self.n)
        of = np.repeat(place, [len(t) for t, _ in rows])
        terms, weights = (np.concatenate([r[k] for r in rows]) if rows else np.zeros(0, (np.int64, float)[k]) for k in (0, 1))
        sort = np.lexsort((of, terms))
        self.docs, self.weights, terms = of[sort].astype(np.int32), weights[sort], terms[sort]
        self.blocks = max(1, -(-self.n // block))
        cell = terms * self.blocks + self.docs // block
        self.starts = np.searchsorted(cell, np.arange(n_terms * self.blocks + 1)).astype(np.int64)
        self.maxima = np.zeros(n_terms * self.blocks)
        np.maximum.at(self.maxima, cell, self.weights)
        self.maxima = self.maxima.reshape(n_terms, self.blocks)
        # a term that many examples hold has its weights spelled out for all of them, which reads faster than a long list
        held = np.bincount(terms, minlength=n_terms)
        self.row = np.full(n_terms, -1)
        often = np.flatnonzero(held * OFTEN > self.n)
        self.row[often] = np.arange(len(often))
        self.spelled = np.zeros((len(often), self.blocks * block))
        own = self.row[terms] >= 0
        self.spelled[self.row[terms[own]], self.docs[own]] = self.weights[own]
        self.spelled = self.spelled.reshape(len(often), self.blocks, block)
        self.read = self.asked = 0

    def _scores(self, terms: np.ndarray, weights: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, cosines) of all examples of some blocks."""
        row = self.row[terms]
        often = row >= 0
        cosines = np.zeros((self.blocks, self.block))
        cosines[blocks] = np.tensordot(weights[often], self.spelled[row[often][:, None], blocks], 1)
        terms, weights = terms[~often], weights[~often]
        cells = terms[:, None] * self.blocks + blocks
        n = self.starts[cells + 1] - self.starts[cells]
        of, which = np.nonzero(n)
        n, a = n[of, which], self.starts[cells[of, which]]
        at = np.arange(n.sum()) + np.repeat(a - (np.cumsum(n) - n), n)
        cosines = cosines.ravel() + np.bincount(self.docs[at], np.repeat(weights[of], n) * self.weights[at], cosines.size)
        places = (blocks[:, None] * self.block + np.arange(self.block)).ravel()
        places = places[places < self.n]
        return places, cosines[places]

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(examples, cosines) of the `k` nearest with a cosine above 0, the nearest first; the smaller number wins a tie."""
        if not len(terms):
            return np.zeros(0, np.int64), np.zeros(0)
        bounds = weights @ self.maxima[terms]
        by_bound = np.argsort(-bounds, kind="stable")
        first = -(-k // self.block) + 1
        places, cosines = self._scores(terms, weights, by_bound[:first])
        least = np.partition(cosines, len(cosines) - k)[len(cosines) - k] if len(cosines) > k else 0.0
        rest = by_bound[first:]
        rest = rest[bounds[rest] >= least - 1e-9]  # sums may differ in their last digits
        if len(rest):
            more = self._scores(terms, weights, rest)
            places, cosines = np.concatenate((places, more[0])), np.concatenate((cosines, more[1]))
        self.asked, self.read = self.asked + self.blocks, self.read + min(first, self.blocks) + len(rest)
        if len(cosines) > k:  # the rest need no order
            some = np.flatnonzero(cosines >= np.partition(cosines, len(cosines) - k)[len(cosines) - k])
            places, cosines = places[some], cosines[some]
        examples = self.order[places]
        best = np.lexsort((examples, -cosines))[:k]
        best = best[cosines[best] > 0]
        return examples[best], cosines[best]


def _alike(rows: list[tuple[np.ndarray, np.ndarray]], n_terms: int, block: int) -> np.ndarray:
    """An order of vectors in which those of a block are alike: halves along the direction in which they differ most."""
    def split(own: np.ndarray) -> list[np.ndarray]:
        if len(own) <= block:
            return [own]
        of = np.repeat(np.arange(len(own)), [len(rows[i][0]) for i in own])
        terms, weights = (np.concatenate([rows[i][k] for i in own]) for k in (0, 1))
        mean = np.bincount(terms, weights, n_terms) / len(own)
        x = np.random.default_rng(13).normal(size=len(own))
        for _ in range(8):
            v = np.bincount(terms, weights * x[of], n_terms) - mean * x.sum()
            x = np.bincount(of, weights * v[terms], len(own)) - mean @ v
            x /= max(1e-12, float(np.linalg.norm(x)))
        half = max(block, len(own) // 2 // block * block)
        by = own[np.argsort(x, kind="stable")]
        return split(by[:half]) + split(by[half:])

    return np.concatenate(split(np.arange(len(rows)))) if rows else np.zeros(0, np.int64)


class Nearest:
    """The fitted model: an index of examples, their labels and ids, and the curve from votes to probabilities."""

    def __init__(self, vectors: Vectors, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, ids: list, share: float) -> None:
        self.vectors, self.labels, self.ids, self.share = vectors, labels, ids, share
        self.plain = len(rows) < 20 or len(np.unique(labels)) < 2
        if self.plain:
            return
        self.index = BlockMaxIndex(rows, len(vectors.numbers))
        self.k = min(MOST, max(FEWEST, len(rows) // ONE_IN))
        self.prior = labels.mean()
        votes = np.zeros(len(rows))
        for i, (terms, weights) in enumerate(rows):
            found, cosines = self.index.nearest(terms, weights, self.k + 1)
            other = found != i
            votes[i] = self.vote(found[other][: self.k], cosines[other][: self.k])
        self.curve = _logistic(votes, labels, np.where(labels > 0, share / self.prior, (1 - share) / (1 - self.prior)))

    def vote(self, found: np.ndarray, cosines: np.ndarray) -> float:
        """Log odds of label 1 by cosines, as if there were as many examples of either label; 0 without any."""
        own = self.labels[found]
        toxic, clean = (cosines * own).sum() / self.prior, (cosines * (1 - own)).sum() / (1 - self.prior)
        return float(np.log((toxic + 0.01 * (toxic + clean) + 1e-12) / (clean + 0.01 * (toxic + clean) + 1e-12)))

    def rate(self, terms: Counter) -> tuple[float, list[dict]]:
        """(probability, evidence) of a text by its terms; without any known term the share of label 1, and no evidence."""
        if self.plain:
            return self.share, []
        found, cosines = self.index.nearest(*self.vectors.of(terms), self.k)
        if not len(found):
            return self.share, []
        slope, level = self.curve
        named = [{"id": self.ids[i], "label": int(self.labels[i]), "cosine": float(c)} for i, c in zip(found[:EVIDENCE], cosines[:EVIDENCE], strict=True)]
        return float(1 / (1 + np.exp(-np.clip(slope * self.vote(found, cosines) + level, -500, 500)))), named


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """(slope, level) of a logistic curve by Newton steps, with a small penalty on the slope."""
    both, w = np.stack((x, np.ones_like(x))), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(w @ both, -30, 30)))
        gradient = both @ (weight * (p - y)) + np.array([1e-2, 0]) * w
        step = np.linalg.solve((both * weight * p * (1 - p)) @ both.T + np.diag([1e-2, 1e-6]), gradient)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def _counted(numbers):
    """A function of batches of texts: (term, n), in how many texts of the task each term of the index is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = numbers.value
        n = np.zeros(len(known) + 1, np.int64)  # the last counts the texts
        for texts in _texts(batches):
            n[-1] += len(texts)
            found = [known[t] for terms in texts for t in terms if t in known]
            n += np.bincount(np.array(found, np.int64), minlength=len(n))
        some = np.flatnonzero(n)
        yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array(n[some])], ["term", "n"])

    return run


def fit(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> Nearest:
    """The model, from at most `sample` documents of either label, `sample_bytes` of text in all.

    These are documents for whose label rows `usable` holds, taken in the order of a hash of their ids; texts that
    no longer fit are passed over. Null labels and labels of no document are passed over; an id with several labels has the
    smallest; documents that share an id are examples each. With under 20 examples or one label only, every score is the
    smoothed share of label 1.
    """
    spark = docs.sparkSession
    given = labels.where(usable & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("y")).where("y in (0, 1)")
    given = stored(given, "given-labels")
    counts = {r.y: r.n for r in given.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
    # neither label has over twice as many examples as the other
    most = {y: min(sample, max(20, 2 * counts.get(1 - y, 0))) for y in (0, 1)}
    first, second = (given.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(most[y]) for y in (0, 1))
    chosen = first.union(second)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    found = texts.join(F.broadcast(chosen), "id").select("id", "y", F.coalesce("text", F.lit("")).alias("text"))
    rows, size = [], 0
    for r in found.orderBy(F.xxhash64("id"), "id", F.xxhash64("text")).limit(2 * sample).toLocalIterator():
        text = r.text.encode()
        if size + len(text) <= sample_bytes:
            size += len(text)
            rows.append((r.id, r.y, terms_of(text)))
    seen = Counter(t for r in rows for t in r[2])
    least = max(LEAST_DOCS, round(LEAST_SHARE * len(rows)))
    terms = sorted(t for t, n in seen.items() if n >= least)
    sent = spark.sparkContext.broadcast({t: i for i, t in enumerate(terms)})
    total = np.zeros(len(terms) + 1, np.int64)
    sums = texts.select("text").mapInArrow(_counted(sent), "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
    for r in sums.collect():  # a row for each term of the index
        total[r.term] = r.n
    vectors = Vectors(terms, total[:-1], int(total[-1]))
    return Nearest(vectors, [vectors.of(r[2]) for r in rows], np.array([r[1] for r in rows], float), [r[0] for r in rows], share)


def rated(text: Column, model) -> Column:
    """A struct of score and evidence by a broadcast model; null and empty texts have no evidence and the share of label 1."""

    @F.arrow_udf("struct<score: double, evidence: array<struct<id: string, label: int, cosine: double>>>")
    def rate(column: pa.Array) -> pa.Array:
        found = []
        for texts in _texts(iter([pa.record_batch([column], ["text"])])):
            found += [model.value.rate(terms) for terms in texts]
        each = pa.struct([("id", pa.string()), ("label", pa.int32()), ("cosine", pa.float64())])
        named = [[{**x, "id": None if x["id"] is None else str(x["id"])} for x in e] for _, e in found]
        return pa.StructArray.from_arrays([pa.array([s for s, _ in found], pa.float64()), pa.array(named, pa.list_(each))], ["score", "evidence"])

    return rate(text)


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 == 0, F.lit(False))


def with_toxicity(docs: DataFrame, labels: DataFrame, score_col: str = "score", evidence_col: str = "evidence", id_col: str = "doc_id", text_col: str = "text", **names) -> DataFrame:
    """`docs` with a toxicity score from 0 to 1 and its evidence, the nearest labelled examples with their cosines.

    Every row, repeated ones and empty texts too, gets a score; columns of these two names are replaced. Labels of held-out
    documents are not learned from. Labels, language, source and id are never inputs of a score. Long texts are read whole.
    """
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, ~held_out(F.col(id_col)), id_col, text_col, **names))
    found = docs.withColumn("_rated", rated(F.col(text_col).cast("string"), model))
    return found.withColumns({score_col: F.col("_rated.score"), evidence_col: F.col("_rated.evidence")}).drop("_rated")


def op13_toxicity(spark, sf_dir: str) -> DataFrame:
    """The contract's rows over the whole `documents` table, with the evidence."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = with_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")
