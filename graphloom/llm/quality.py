"""Document quality from random-indexing word vectors and a two-layer network with calibrated probabilities.

Tokens are words and runs of other signs, as they are written. Each owns a sparse ternary index vector that its hash picks
from a fixed table, and the vector of a token is the sum of the index vectors beside its occurrences in all documents, at
unit length. Tokens share the rows of a table of fixed size by their hash, so the sums of a task, of the shuffle and of the
model are bounded however large the corpus is, and no token is left out. A document is the mean over all its tokens. A small
numpy network is fitted on the driver to the vectors of a bounded sample of labelled documents, and a temperature fitted on
rows that the network did not see turns its output into probabilities. Scoring reads every whole text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import pieces_of, stored, texts_as_bytes

DIM, HIDDEN, TABLE, ONES = 64, 32, 1 << 16, 6
#: Places to each side that are contexts; rows of the table that travel together.
AROUND, ROWS = 1, 256
#: Bound of what the fit reads: labelled documents.
SAMPLE_DOCS = 20_000
THRESHOLD = 0.7
#: Bytes of text and tokens that are held at once, and tokens whose rows a worker remembers.
HELD_BYTES, HELD_TOKENS, REMEMBERED = 1_000_000, 100_000, 300_000

_TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x00-\x20]+")
_BLANK = re.compile(rb"[\x00-\x20]")


def index_vectors() -> np.ndarray:
    """The fixed table: in each row a few entries are +1 or -1."""
    random = np.random.default_rng(10)
    out = np.zeros((TABLE, DIM), np.int8)
    where = random.random((TABLE, DIM)).argpartition(ONES, axis=1)[:, :ONES]
    out[np.arange(TABLE)[:, None], where] = random.choice(np.int8([-1, 1]), (TABLE, ONES))
    return out


class Slots(dict):
    """Rows of the table by token, with those of past tokens remembered up to a number."""

    def __missing__(self, token: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        found = self[token] = zlib.crc32(token) & (TABLE - 1)
        return found

    def of(self, text: bytes) -> np.ndarray:
        """Rows of all tokens of a text in order; a long text is cut at blanks to be read."""
        parts, at = [], 0
        while at < len(text):
            end = _BLANK.search(text, at + HELD_BYTES) if len(text) - at > HELD_BYTES else None
            upto = end.start() if end else len(text)
            tokens = _TOKEN.findall(text[at:upto])
            parts.append(np.fromiter(map(self.__getitem__, tokens), np.int32, len(tokens)))
            at = upto
        return np.concatenate(parts) if parts else np.zeros(0, np.int32)


def _pieces(batch: pa.RecordBatch, slots: Slots) -> Iterator[list[np.ndarray]]:
    for rows in pieces_of(batch, HELD_BYTES):
        yield [slots.of(x) for x in texts_as_bytes(rows.column("text"))]


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the index vectors beside each row's tokens: (block of rows, int32 sums) for blocks with any."""
    slots, sums = Slots(), np.zeros((TABLE, DIM), np.int32)
    index = np.concatenate((index_vectors(), np.zeros((1, DIM), np.int8)))
    gap = np.full(AROUND, TABLE, np.int32)  # nothing, between texts
    for batch in batches:
        for texts in _pieces(batch, slots):
            places = np.concatenate([gap, *(x for text in texts for x in (text, gap))])
            for a in range(AROUND, len(places) - AROUND, HELD_TOKENS):
                b = min(len(places) - AROUND, a + HELD_TOKENS)
                near = index[places[a - AROUND : b + AROUND]]
                beside = np.zeros((b - a, DIM), np.int8)
                for step in range(2 * AROUND + 1):
                    if step != AROUND:
                        beside += near[step : step + b - a]
                order = np.argsort(places[a:b], kind="stable")
                own = places[a:b][order]
                starts = np.concatenate(([0], np.flatnonzero(np.diff(own)) + 1))
                added, own = np.add.reduceat(beside[order], starts, axis=0, dtype=np.int32), own[starts]
                sums[own[own < TABLE]] += added[own < TABLE]
    blocks = sums.reshape(-1, ROWS * DIM)
    some = np.flatnonzero(blocks.any(axis=1))
    for k in range(0, len(some), 16):
        yield pa.record_batch([pa.array(some[k : k + 16].astype(np.int32)), pa.array([blocks[i].tobytes() for i in some[k : k + 16]], pa.binary())], ["block", "sums"])


def rounded(vectors: np.ndarray) -> np.ndarray:
    """Entries from -1 to 1 as multiples of 2**-20: sums of up to 2**33 of them are exact in double precision, in any order."""
    return (np.rint(vectors * (1 << 20)) / (1 << 20)).astype(np.float32)


def _added(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The vectors of a block, at unit length, from the sums of all tasks."""
    total = np.zeros((ROWS, DIM), np.int64)
    for batch in batches:
        for x in batch.column(batch.schema.get_field_index("sums")):
            total += np.frombuffer(x.as_buffer(), np.int32).reshape(ROWS, DIM)
    unit = rounded(total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-6))
    yield pa.record_batch([pa.array([key[0].as_py()], pa.int32()), pa.array([unit.tobytes()], pa.binary())], ["block", "vectors"])


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The table of vectors, learned over all of `docs`: `TABLE` rows, 16 MB, whatever the corpus's size."""
    sums = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_contexts, "block int, sums binary")
    out = np.zeros((TABLE // ROWS, ROWS * DIM), np.float32)
    for block, vectors in sums.groupBy("block").applyInArrow(_added, "block int, vectors binary").collect():  # 256 rows at most
        out[block] = np.frombuffer(vectors, np.float32)
    return out.reshape(TABLE, DIM)


class Pooler:
    """Mean token vectors of documents; a document's is the same to the last bit however rows are dealt to tasks and batches."""

    def __init__(self, vectors: np.ndarray) -> None:
        self.vectors = vectors
        self.slots: Slots | None = None

    def __getstate__(self) -> dict:
        return {"vectors": self.vectors, "slots": None}

    def pool(self, column: pa.Array) -> np.ndarray:
        if self.slots is None:
            self.slots = Slots()
        out, first = np.zeros((len(column), DIM)), 0
        for texts in _pieces(pa.record_batch([column], ["text"]), self.slots):
            lens = np.fromiter(map(len, texts), np.int64, len(texts))
            of, places = np.repeat(np.arange(len(texts)), lens), np.concatenate(texts)
            for a in range(0, len(places), HELD_TOKENS):
                part = of[a : a + HELD_TOKENS]
                starts = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1))
                out[first + part[starts]] += np.add.reduceat(self.vectors[places[a : a + HELD_TOKENS]], starts, axis=0, dtype=np.float64)
            out[first : first + len(texts)] /= np.maximum(lens, 1)[:, None]
            first += len(texts)
        return out


class Network:
    """Two layers over standardised vectors; `temperature` divides the output before the sigmoid."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 10, epochs: int = 60, rate: float = 0.01) -> None:
        random = np.random.default_rng(seed)
        self.prior = float((y.sum() + 1) / (len(y) + 2))
        self.plain = len(y) < 20 or len(np.unique(y)) < 2
        if self.plain:
            return
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        z = (x - self.mean) / self.scale
        order = random.permutation(len(z))
        kept, seen = order[: len(z) // 5], order[len(z) // 5 :]
        self.w = [random.normal(0, 1 / np.sqrt(DIM), (DIM, HIDDEN)), np.zeros(HIDDEN), random.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        mean, square, step = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        for _ in range(epochs):
            for rows in np.array_split(random.permutation(seen), max(1, len(seen) // 128)):
                hidden = np.tanh(z[rows] @ self.w[0] + self.w[1])
                error = (1 / (1 + np.exp(-np.clip(hidden @ self.w[2] + self.w[3], -50, 50))) - y[rows]) / len(rows)
                back = np.outer(error, self.w[2]) * (1 - hidden**2)
                step += 1
                for k, g in enumerate((z[rows].T @ back + 1e-4 * self.w[0], back.sum(axis=0), hidden.T @ error + 1e-4 * self.w[2], error.sum(keepdims=True))):
                    mean[k] = 0.9 * mean[k] + 0.1 * g
                    square[k] = 0.999 * square[k] + 0.001 * g**2
                    self.w[k] = self.w[k] - rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
        out, target = self.raw(x[kept]), y[kept]
        losses = {t: np.logaddexp(0, np.where(target > 0, -out, out) / t).mean() for t in np.geomspace(0.25, 8, 61).tolist()}
        self.temperature = min(losses, key=losses.get)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def probability(self, x: np.ndarray) -> np.ndarray:
        if self.plain:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.raw(x) / self.temperature, -500, 500)))


def fit(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE_DOCS) -> tuple[Pooler, Network]:
    """The model: vectors learned over all of `docs`, and a network fitted to at most `sample` labelled documents.

    These are documents for whose label rows `usable` holds, chosen by a hash of their ids.
    Null labels and labels of no document are passed over; an id with several labels has the smallest. With under 20 labelled
    documents or one class only, every score is the smoothed share of label 1.
    """
    spark = docs.sparkSession
    pooler = Pooler(word_vectors(docs, text_col))
    chosen = labels.where(usable & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("double").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    found = stored(texts.join(F.broadcast(chosen), "id").select("text", "y").repartition(16), "labelled")
    rows = found.select("y", pooled(F.col("text"), spark.sparkContext.broadcast(pooler)).alias("x")).collect()
    rows.sort(key=lambda r: (r.y, r.x))
    x = np.array([r.x for r in rows], float).reshape(-1, DIM)
    return pooler, Network(x, np.array([r.y for r in rows], float))


def pooled(text: Column, pooler) -> Column:
    @F.arrow_udf("array<float>")
    def pool(column: pa.Array) -> pa.Array:
        x = pooler.value.pool(column).astype(np.float32)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * DIM, pa.int32()), pa.array(x.ravel()))

    return pool(text)


def quality_score(text: Column, model) -> Column:
    """Calibrated probability of label 1 by a broadcast (pooler, network); null and empty texts are scored as no words."""

    @F.arrow_udf("double")
    def rate(column: pa.Array) -> pa.Array:
        pooler, network = model.value
        return pa.array(network.probability(pooler.pool(column)))

    return rate(text)


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == 2, F.lit(False))


def with_quality(docs: DataFrame, labels: DataFrame, out_col: str = "score", **names) -> DataFrame:
    """`docs` with a quality score from 0 to 1 in `out_col`; every row, repeated ones and empty texts too, gets one.

    Labels of held-out documents are not learned from. Labels, language, source and id are never inputs of a score.
    """
    model = fit(docs, labels, ~held_out(F.col(names.get("id_col", "doc_id"))), **names)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return docs.withColumn(out_col, quality_score(F.col(names.get("text_col", "text")).cast("string"), sent))


def op10_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """The contract's rows over the whole `documents` table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = with_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of `docs` whose score reaches the threshold; same columns."""
    return with_quality(docs, labels, "_quality").where(F.col("_quality") >= threshold).select(docs.columns)
