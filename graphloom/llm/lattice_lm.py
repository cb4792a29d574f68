"""Language-model scores of a subword lattice.

The pieces of an existing vocabulary, with one log-probability each, weight every segmentation of a text, and a forward
recursion in log space sums them all: the result is the text's marginal probability. Pieces lie within words, so the
recursion runs once for each distinct word of the corpus, whatever its frequency, and a document adds up its words and
one end. The vocabulary's own scores give the first log-probabilities; expected counts over the words of all training
documents, each as often as it occurs, then fit them. The list of pieces never changes, and no other path is added.

Word statistics are counted over all documents. A document's frequent words are looked up in a table of bounded size that
every worker holds; its other words are joined with the table of all words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from graphloom.llm import vocabulary
from graphloom.llm.common import pieces_of, stored, texts_as_bytes
from graphloom.llm.vocabulary import Vocabulary

#: Words that are counted before a worker passes them on; frequent words that every worker holds, and their length.
FLUSH_WORDS, HEAD_WORDS, HEAD_BYTES = 200_000, 100_000, 40
#: Longer words that every worker holds as well, and their length.
LONG_WORDS, LONG_BYTES = 2_000, 4_096
#: Bytes of words whose lattices are summed together; a longer word's edges are found in parts of so many bytes.
LATTICE_BYTES = 300_000
#: Bytes of text or words that a worker holds as Python objects.
HELD_BYTES = 4_000_000


class Lattice:
    """All segmentations of words into pieces. Symbols: the vocabulary's ids, and one past them for a text's end."""

    def __init__(self, vocab: Vocabulary) -> None:
        self.size = len(vocab.surfaces) + 1
        children: dict[int, int] = {}
        ends: list[int] = [-1]
        for i in vocab.normal.tolist():
            node = 0
            for byte in vocab.surfaces[i]:
                node = children.setdefault(node * 256 + byte, len(ends))
                if node == len(ends):
                    ends.append(-1)
            ends[node] = i
        self.piece = np.array(ends, np.int32)
        self.keys = np.array(sorted(children))
        self.nodes = np.array([children[k] for k in self.keys.tolist()])
        self.two = np.full(65536, -1)  # the first two steps by one look-up
        first = {k: v for k, v in children.items() if k < 256}
        for k, v in children.items():
            for byte, node in first.items():
                if k >> 8 == node:
                    self.two[byte * 256 + (k & 255)] = v
        self.one = np.full(256, -1)
        for byte, node in first.items():
            self.one[byte] = node
        self.byte_ids = vocab.byte_ids.astype(np.int32)
        self.longest = max((len(vocab.surfaces[i]) for i in vocab.normal.tolist()), default=1)

    def first_weights(self, vocab: Vocabulary) -> np.ndarray:
        """Log-probabilities by the vocabulary's own scores.

        Scores of a unigram vocabulary are log-probabilities and stay as they are, but for one sum that brings all symbols
        to 1. Scores that are no log-probabilities (a merge model has ranks) count by their order, as 1 / (rank + 10). Byte
        pieces and the end have no scores: bytes come last in that order, the end first.
        """
        usable = np.zeros(self.size, bool)
        usable[vocab.normal] = usable[self.byte_ids] = usable[-1] = True
        own = vocab.scores[vocab.normal]
        if len(own) and 0.5 <= np.exp(np.minimum(own, 50)).sum() <= 2:
            weight = np.full(self.size, np.exp(own.min()))
            weight[vocab.normal] = np.exp(own)
            weight[-1] = np.exp(own.max())
        else:
            rank = np.full(self.size, float(self.size))
            rank[vocab.normal[np.argsort(-own, kind="stable")]] = np.arange(len(own))
            rank[-1] = 0
            weight = 1 / (rank + 10)
        return np.log(np.where(usable, weight / weight[usable].sum(), 1e-300))

    def _edges(self, data: np.ndarray, left: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, size, piece) of all edges that start at the bytes from `a` to `b`; `left` has the bytes to each word's end."""
        starts = np.arange(a, b, dtype=np.int64)
        found = [(starts, np.ones(len(starts), np.int64), self.byte_ids[data[a:b]])]
        at, node = starts, self.one[data[a:b]]
        for size in range(1, self.longest + 1):
            live = node >= 0
            at, node = at[live], node[live]
            whole = self.piece[node] >= 0
            found.append((at[whole], np.full(int(whole.sum()), size), self.piece[node[whole]]))
            more = left[at] > size
            at, node = at[more], node[more]
            if not len(at):
                break
            ahead = data[at + size].astype(np.int64)
            if size == 1:
                node = self.two[data[at].astype(np.int64) * 256 + ahead]
            else:
                want = node * 256 + ahead
                place = np.searchsorted(self.keys, want)
                place[place == len(self.keys)] = 0
                node = np.where(self.keys[place] == want, self.nodes[place], -1)
        start, size, piece = (np.concatenate(x) for x in zip(*found, strict=True))
        return start, size, piece

    def _sum(self, words: list[bytes], weights: np.ndarray, counts: np.ndarray | None, expected: np.ndarray | None) -> np.ndarray:
        """Log marginals of words of at most `LATTICE_BYTES` bytes together, or of one longer word."""
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        data = np.frombuffer(b" " + b" ".join(words), np.uint8)
        heads = np.cumsum(sizes) - sizes
        word = np.repeat(np.arange(len(words)), sizes)
        step = np.arange(len(data)) - heads[word]
        left = sizes[word] - step
        longest, many = int(sizes.max()), len(words) > 1
        alpha = np.full(len(data) + len(words), -np.inf)  # a word has one node more than bytes
        alpha[heads + np.arange(len(words))] = 0
        ends = heads + sizes + np.arange(len(words))
        parts = [(0, longest)] if many else [(k, min(longest, k + LATTICE_BYTES)) for k in range(0, longest, LATTICE_BYTES)]

        def edges(a: int, b: int, by_end: bool) -> tuple[np.ndarray, ...]:
            """Edges that end (or start) at steps over `a` (from `a`) up to `b`, in groups of one end (start), by ascending steps."""
            start, size, piece = self._edges(data, left, 0, len(data)) if many else self._edges(data, left, max(0, a - self.longest), b)
            source = start + word[start]
            of = step[start] + size * by_end
            keep = (of > a) & (of <= b) if by_end else (of >= a) & (of < b)
            if not keep.all():
                source, size, piece, of = source[keep], size[keep], piece[keep], of[keep]
            key = source + size if by_end else source
            order = np.lexsort((key, of))
            source, size, piece, of, key = source[order], size[order], piece[order], of[order], key[order]
            heads_ = np.flatnonzero(np.diff(key, prepend=-1) != 0)
            return source, source + size, piece, heads_, key[heads_], np.flatnonzero(np.diff(of[heads_], prepend=-1) != 0)

        for a, b in parts:
            source, _, piece, group, node, cut = edges(a, b, True)
            weight, group_end = weights[piece], np.append(group, len(source))
            for g, h in zip(cut.tolist(), [*cut[1:].tolist(), len(group)], strict=True):
                e, f = group_end[g], group_end[h]
                alpha[node[g:h]] = np.logaddexp.reduceat(alpha[source[e:f]] + weight[e:f], group[g:h] - e)
        total = alpha[ends]
        if expected is not None:
            beta = np.full(len(alpha), -np.inf)
            beta[ends] = 0
            owner = np.repeat(np.arange(len(words)), sizes + 1)
            for a, b in reversed(parts):
                source, target, piece, group, node, cut = edges(a, b, False)
                weight, group_end = weights[piece], np.append(group, len(source))
                for g, h in reversed(list(zip(cut.tolist(), [*cut[1:].tolist(), len(group)], strict=True))):
                    e, f = group_end[g], group_end[h]
                    beta[node[g:h]] = np.logaddexp.reduceat(beta[target[e:f]] + weight[e:f], group[g:h] - e)
                share = np.exp(alpha[source] + weight + beta[target] - total[owner[source]]) * counts[owner[source]]
                expected += np.bincount(piece, share, minlength=len(expected))
        return total

    def log_marginals(self, words: list[bytes], weights: np.ndarray, counts: np.ndarray | None = None, expected: np.ndarray | None = None) -> np.ndarray:
        """Log-probability of each word over all its segmentations; adds expected counts of pieces to `expected` if given.

        Words of like sizes go together, up to `LATTICE_BYTES`; time and memory grow with the bytes of words alone.
        """
        out = np.zeros(len(words))
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        order = np.argsort(sizes, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(np.cumsum(sizes[order]) // LATTICE_BYTES)) + 1):
            if len(rows):
                out[rows] = self._sum([words[k] for k in rows.tolist()], weights, None if counts is None else counts[rows], expected)
        return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, training count, count) of (held_out, text) rows, summed as far as memory allows."""
    seen: tuple[Counter, Counter] = (Counter(), Counter())

    def flush() -> pa.RecordBatch:
        words = list({**seen[0], **seen[1]})
        train = [seen[0][w] for w in words]
        every = [a + seen[1][w] for a, w in zip(train, words, strict=True)]
        for x in seen:
            x.clear()
        return pa.record_batch([pa.array(words, pa.binary()), pa.array(train, pa.int64()), pa.array(every, pa.int64())], ["word", "c", "n"])

    for batch in batches:
        for rows in pieces_of(batch, HELD_BYTES):
            for held, text in zip(rows.column(0).to_pylist(), texts_as_bytes(rows.column(1)), strict=True):
                seen[held].update(text.lower().split())
                if len(seen[0]) + len(seen[1]) > FLUSH_WORDS:
                    yield flush()
    yield flush()


def _expect(lattice: Lattice, weights: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    expected = np.zeros(lattice.size)
    for batch in batches:
        for rows in pieces_of(batch, HELD_BYTES, "word"):
            lattice.log_marginals(rows.column(0).to_pylist(), weights, rows.column(1).to_numpy().astype(float), expected)
    some = np.flatnonzero(expected)
    yield pa.record_batch([pa.array(some), pa.array(expected[some])], ["piece", "n"])


def _marginals(lattice: Lattice, weights: list[np.ndarray], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in pieces_of(batch, HELD_BYTES, "word"):
            words = rows.column(0).to_pylist()
            found = [pa.array(lattice.log_marginals(words, w) / np.log(10)) for w in weights]
            yield pa.record_batch([*rows.columns, *found], ["word", "c", "n", "lp", "own"])


def fit(words: DataFrame, n_docs: int, lattice: Lattice, vocab: Vocabulary, rounds: int) -> np.ndarray:
    """Log-probabilities of all symbols after `rounds` of expectation and maximisation over all training words and ends.

    A hundredth of a count for every symbol, spread like the first weights, keeps all pieces possible. Without training
    words the vocabulary's weights stay.
    """
    first = lattice.first_weights(vocab)
    weights = first
    sent = words.sparkSession.sparkContext.broadcast(lattice)
    for _ in range(rounds if n_docs else 0):
        now = weights
        found = words.where("c > 0").select("word", "c").mapInArrow(lambda b, now=now: _expect(sent.value, now, b), "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n"))
        counts = np.exp(first) * 0.01 * lattice.size
        for piece, n in found.orderBy("piece").collect():  # at most one row for each piece of the vocabulary
            counts[piece] += n
        counts[-1] += n_docs
        weights = np.log(counts / counts.sum())
    return weights


def _documents(head: dict[bytes, int], logs: np.ndarray, batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """For (id, held_out, text): a row of sums over frequent words for each document, and a row for each other word of it.

    logs: for each frequent word its base term, its log-probability, that by the vocabulary's own scores, and whether
    training has it.
    """
    part, n = TaskContext.get().partitionId(), 0
    out: dict[str, list] = {f.name: [] for f in schema}
    get = head.get

    def flush() -> pa.RecordBatch:
        batch = pa.record_batch([pa.array(out[f.name], f.type) for f in schema], schema=schema)
        for x in out.values():
            x.clear()
        return batch

    for batch in batches:
        for rows in pieces_of(batch, HELD_BYTES):
            for doc, held, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), texts_as_bytes(rows.column(2)), strict=True):
                key = (part << 40) + n
                n += 1
                times = Counter(text.lower().split())
                words = list(times)
                tf, places = np.fromiter(times.values(), np.int64, len(words)), np.fromiter((get(w, -1) for w in words), np.int64, len(words))
                common = places >= 0
                sums = tf[common] @ logs[places[common]]
                tail = np.flatnonzero(~common).tolist()
                out["row"] += [key] * (1 + len(tail))
                out["id"] += [doc] + [None] * len(tail)
                out["held_out"] += [held] + [None] * len(tail)
                out["n_tokens"] += [int(tf.sum()) + 1] + [0] * len(tail)
                for name, x in zip(("base", "lp_sum", "own_sum"), sums.tolist(), strict=False):
                    out[name] += [x] + [0.0] * len(tail)
                out["known"] += [int(sums[3])] + [0] * len(tail)
                out["word"] += [b" %d" % key, *(words[k] for k in tail)]
                out["tf"] += [0, *tf[tail].tolist()]
                if len(out["row"]) > 50_000:
                    yield flush()
    yield flush()


def is_held_out(id_col: Column, modulus: int, rest: int) -> Column:
    """Whether crc32 of the id as text leaves `rest`; a null id is not held out."""
    return F.coalesce(F.crc32(id_col.cast("string")) % modulus == rest, F.lit(False))


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", model: str = vocabulary.DEFAULT_MODEL, rounds: int = 2, head_words: int = HEAD_WORDS) -> DataFrame:
    """(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score, vocabulary_score), a row for each row of `docs`.

    Words are runs without white space, A-Z in lower case; a document's tokens are its words and one end. base_score sums
    log10((c+1)/(N+V+1)) over tokens. score is the marginal log10 probability of the words and the end over all
    segmentations into pieces, with the pieces' fitted probabilities; vocabulary_score is the same by the vocabulary's own
    scores alone. Null and empty texts have the end alone; repeated rows give repeated results, and count as often in
    training; without any training text c, N and V are 0 and both scores are by the vocabulary's; an empty table gives no rows.
    """
    spark = docs.sparkSession
    vocab = vocabulary.load(model)
    lattice = Lattice(vocab)
    rows = docs.select(F.col(id_col).alias("id"), held_out.alias("held_out"), F.col(text_col).cast("string").alias("text"))
    words = stored(rows.select("held_out", "text").mapInArrow(_count, "word binary, c long, n long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n")), "words")
    n_train = rows.where(~F.col("held_out")).count()
    total, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    total, distinct = total + n_train, distinct + (n_train > 0)
    own, weights = lattice.first_weights(vocab), fit(words, n_train, lattice, vocab, rounds)
    sent = spark.sparkContext.broadcast(lattice)
    table = stored(words.mapInArrow(lambda b: _marginals(sent.value, [weights, own], b), "word binary, c long, n long, lp double, own double"), "word-scores")
    below = float(np.log10(total + distinct + 1))
    often = table.where("n > 1").withColumn("size", F.length("word"))
    top = often.where(F.col("size") <= HEAD_BYTES).orderBy(F.desc("n"), "word").limit(head_words).collect()
    top += often.where((F.col("size") > HEAD_BYTES) & (F.col("size") <= LONG_BYTES)).orderBy(F.desc("n"), "word").limit(min(head_words, LONG_WORDS)).collect()
    head = {bytes(r.word): k for k, r in enumerate(top)}
    logs = np.array([(np.log10(r.c + 1) - below, r.lp, r.own, r.c > 0) for r in top], float).reshape(-1, 4)
    held = spark.sparkContext.broadcast((head, logs))
    long, double = T.LongType(), T.DoubleType()
    schema = T.StructType([T.StructField("row", long), T.StructField("id", docs.schema[id_col].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", long), T.StructField("known", long), *(T.StructField(x, double) for x in ("base", "lp_sum", "own_sum")), T.StructField("word", T.BinaryType()), T.StructField("tf", long)])
    arrow = to_arrow_schema(schema)
    parts = rows.mapInArrow(lambda b: _documents(*held.value, b, arrow), schema)
    joined = parts.join(table.select("word", "c", "lp", "own"), "word", "left")
    tf, seen = F.col("tf"), F.coalesce("c", F.lit(0))
    sums = joined.groupBy("row").agg(
        F.max("id").alias("id"), F.max("held_out").alias("held_out"), F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("known") + F.when(seen > 0, tf).otherwise(0)).alias("known"),
        F.sum(F.col("base") + tf * (F.log10(seen + 1) - below)).alias("base"),
        F.sum(F.col("lp_sum") + F.coalesce(tf * F.col("lp"), F.lit(0.0))).alias("score"),
        F.sum(F.col("own_sum") + F.coalesce(tf * F.col("own"), F.lit(0.0))).alias("own"),
    )
    end_base, end, end_own = float(np.log10(n_train + 1) - below), float(weights[-1] / np.log(10)), float(own[-1] / np.log(10))
    return sums.select(F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("known") + int(n_train > 0)).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"), (F.col("base") + end_base).alias("base_score"), (F.col("score") + end).alias("score"), (F.col("own") + end_own).alias("vocabulary_score"))


def op5_lattice_lm(spark, sf_dir: str) -> DataFrame:
    """The contract's rows over the whole `documents` table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs, is_held_out(F.col("doc_id"), 7, 2))
