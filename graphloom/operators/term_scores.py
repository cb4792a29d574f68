"""BM25 scores of whole documents in a task: each text is split once, and no pair of a posting and a query is ever a row."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructType

from graphloom.operators.components import ensure_checkpoints

#: Scores, and parts of them, that a task holds at once.
MOST_CELLS, MOST_PARTS = 1 << 21, 1 << 22


class QueryTerms:
    """Queries (query, term, qtf) that fit: term k (`names[k]`) is in the queries `of[starts[k]:starts[k + 1]]`, `qtf` times."""

    def __init__(self, terms: DataFrame) -> None:
        rows = terms.toArrow().combine_chunks()
        queries, names = (rows.column(x).combine_chunks().dictionary_encode(null_encoding="encode") for x in ("query", "term"))
        term, of = (x.indices.to_numpy().astype(np.int64) for x in (names, queries))
        order = np.lexsort((of, term))
        self.type, self.ids, self.names = terms.schema["query"].dataType, queries.dictionary, names.dictionary.to_pylist()
        self.of, self.qtf = of[order], rows.column("qtf").to_numpy()[order].astype(np.float64)
        self.starts = np.searchsorted(term[order], np.arange(len(self.names) + 1))
        # as in a join, a query without an id is none whose terms a document can all hold
        self.wanted = np.where(self.ids.is_valid(), np.bincount(of, minlength=len(self.ids)), -1)


def held_terms(docs: DataFrame, asked: QueryTerms, words: Column, doc_id: str) -> DataFrame:
    """(doc, dl, terms, tfs), stored: the number of a row's words, which of the queries' terms it holds, and how often."""
    spark = docs.sparkSession
    ensure_checkpoints(spark)
    names = spark.sparkContext.broadcast(asked.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(names.value, pa.string())
        for batch in batches:
            size = pa.compute.list_value_length(batch.column("w")).to_numpy(zero_copy_only=False).astype(np.int64)
            at = pa.compute.index_in(batch.column("w").flatten(), value_set=known)
            row = np.repeat(np.arange(len(size)), size)[at.is_valid().to_numpy(zero_copy_only=False)]
            pair, n = np.unique(row * max(1, len(known)) + at.drop_null().to_numpy().astype(np.int64), return_counts=True)
            row, term = np.divmod(pair, max(1, len(known)))
            ends = pa.array(np.searchsorted(row, np.arange(len(size) + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (term, n)]
            yield pa.record_batch([batch.column("doc"), pa.array(size.astype(np.int32)), *lists], ["doc", "dl", "terms", "tfs"])

    split = docs.select(F.col(doc_id).alias("doc"), words.alias("w"))
    schema = StructType().add("doc", split.schema["doc"].dataType).add("dl", IntegerType()).add("terms", ArrayType(IntegerType())).add("tfs", ArrayType(IntegerType()))
    path = f"{spark.sparkContext.getCheckpointDir()}/held-{uuid.uuid4().hex}"
    split.mapInArrow(run, schema).write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def _best(scores: np.ndarray, matched: np.ndarray, docs: pa.Array, k: int, margin: float) -> np.ndarray:
    """Which of a block's scores (by query and document) may be among a query's best `k` in all.

    Those whose score is within `margin` of the block's `k`-th; of equal scores the `k` smallest documents.
    """
    most = np.where(matched > 0, scores, -np.inf)
    least = np.partition(most, most.shape[1] - k, axis=1)[:, most.shape[1] - k, None] if most.shape[1] > k else -np.inf
    query, at = np.nonzero((matched > 0) & (most >= least - margin))
    place = np.empty(len(docs), np.int64)
    place[pa.compute.sort_indices(docs).to_numpy()] = np.arange(len(docs))
    score = scores[query, at]
    order = np.lexsort((place[at], score, query))
    query, at, score = query[order], at[order], score[order]
    first = np.flatnonzero(np.r_[True, (np.diff(query) != 0) | (np.diff(score) != 0)][: len(query)])
    early = np.arange(len(query)) - np.repeat(first, np.diff(first, append=len(query))) < k
    out = np.zeros(scores.shape, bool)
    out[query[early], at[early]] = True
    return out


def scored(held: DataFrame, asked: QueryTerms, idf: np.ndarray, avgdl: float, k1: float, b: float, all_terms: bool, best: int | None, whole: bool, margin: float = 2e-6) -> DataFrame:
    """(query, doc, score, matched) of rows that hold a term of a query, and further columns of `held`; see `search.bm25`."""
    extra = [f for f in held.schema.fields if f.name not in ("doc", "dl", "terms", "tfs")]
    names = ["query", "doc", "score", "matched", *(f.name for f in extra)]
    sent = held.sparkSession.sparkContext.broadcast((asked.ids, asked.starts, asked.of, asked.qtf * np.repeat(idf, np.diff(asked.starts)), asked.wanted))

    def block(docs: pa.Array, beside: list[pa.Array], dl: np.ndarray, row: np.ndarray, term: np.ndarray, tf: np.ndarray) -> pa.RecordBatch:
        ids, starts, of, weights, wanted = sent.value
        n = np.diff(starts)[term]
        at = np.repeat(starts[term] - np.cumsum(n) + n, n) + np.arange(n.sum())
        cell = of[at] * len(docs) + np.repeat(row, n)
        # added up in the order of terms, so copies of a text have the same score
        part = weights[at] * np.repeat(tf, n) * (k1 + 1) / np.repeat(tf + k1 * (1 - b + b * dl[row] / avgdl), n)
        shape = (len(ids), len(docs))
        scores, matched = (np.bincount(cell, x, len(ids) * len(docs)).reshape(shape) for x in (part, None))
        full = matched == wanted[:, None]
        keep = full if all_terms else matched > 0
        if best is not None:
            some = _best(scores, np.where(keep, matched, 0), docs, best, margin)
            keep = some | full if whole else some
        query, doc = np.nonzero(keep)
        return pa.record_batch([ids.take(pa.array(query)), docs.take(pa.array(doc)), pa.array(scores[query, doc]), pa.array(matched[query, doc].astype(np.int64)), *(x.take(pa.array(doc)) for x in beside)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, starts, *_ = sent.value
        each = max(1, MOST_CELLS // max(1, len(ids)))
        for batch in batches:
            size = pa.compute.list_value_length(batch.column("terms")).to_numpy(zero_copy_only=False).astype(np.int64)
            dl, term = batch.column("dl").to_numpy().astype(np.float64), batch.column("terms").flatten().to_numpy()
            tf, ends = batch.column("tfs").flatten().to_numpy().astype(np.float64), np.r_[0, np.cumsum(size)]
            parts = np.r_[0, np.cumsum(np.diff(starts)[term])][ends]
            a = 0
            while a < len(size):
                z = max(a + 1, min(a + each, int(np.searchsorted(parts, parts[a] + MOST_PARTS, "right")) - 1))
                some = slice(ends[a], ends[z])
                if ends[z] > ends[a]:
                    yield block(batch.column("doc").slice(a, z - a), [batch.column(f.name).slice(a, z - a) for f in extra], dl[a:z], np.repeat(np.arange(z - a), size[a:z]), term[some], tf[some])
                a = z

    schema = StructType().add("query", asked.type).add("doc", held.schema["doc"].dataType).add("score", DoubleType()).add("matched", LongType())
    for field in extra:
        schema = schema.add(field.name, field.dataType)
    return held.mapInArrow(run, schema)
