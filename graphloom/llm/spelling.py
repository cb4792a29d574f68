"""Spelling variants of words, found by generating every neighbour of every word.

Words are counted over all documents with built-in functions. Each word then emits its whole neighbourhood: all distinct
deletions, replacements and insertions over the alphabet that the words themselves show. A neighbour that is a word is near,
and nothing else has to be compared, so an equi-join of neighbours with the vocabulary finds all pairs exactly. Neighbours
are first worked out as hashes, each from its word's by one addition, and asked of a broadcast bitmap of the vocabulary;
only those that may be words are spelled out and shuffled. The bitmap has a bounded size: a larger vocabulary is searched
in several passes, each with the bitmap of one slice of it.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import stored

LEAST_LENGTH, LEAST_N, TYPO_EVERY, RATIO = 7, 2, 31, 10
#: Bits of the bitmap for each word, the most bits of one bitmap, and the bits of a block of it.
BITS_EACH, MOST_BITS, BLOCK = 32, 1 << 28, 1 << 16
#: Hashes that are worked out at once.
CELLS = 1 << 15
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Odd factors of the hash of a word, its inverse modulo 2^64, and those that make two places of it.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
FACTORS = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_n: int = LEAST_N, typo_every: int | None = TYPO_EVERY) -> DataFrame:
    """(word, n) of the words with `least_length` code points or more that occur `least_n` times or more in all texts.

    A word is a maximal run of Latin letters with A-Z lower-cased. With `typo_every`, a run whose CRC-32 of `<id>:<run>` it
    divides loses one letter, whose place the checksum tells. A null id counts as an empty one, a null text has no words.
    """
    found = F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(rf"[A-Za-zÀ-ÿ]{{{least_length},}}+"), F.lit(0))
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.transform(found, lambda x: F.translate(x, UPPER, LOWER))).alias("word"))
    if typo_every:
        hashed = rows.select("word", F.crc32(F.concat("id", F.lit(":"), "word")).alias("h"))
        at = (F.col("h") % F.length("word")).cast("int")
        shorter = F.concat(F.substr("word", F.lit(1), at), F.substr("word", at + 2))
        rows = hashed.select(F.when(F.col("h") % typo_every == 0, shorter).otherwise(F.col("word")).alias("word")).where(F.length("word") >= least_length)
    return rows.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_n)


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, letters) of the words of each length: their numbers in the column, and a matrix of their letters."""
    texts = [x.encode("latin-1") for x in column.to_pylist()]
    order = sorted(range(len(texts)), key=lambda k: len(texts[k]))
    for size, same in itertools.groupby(order, key=lambda k: len(texts[k])):
        rows = np.fromiter(same, np.int64)
        if size:
            yield rows, np.frombuffer(b"".join(texts[k] for k in rows), np.uint8).reshape(len(rows), size)


def _powers(n: int) -> np.ndarray:
    return np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(n, BASE, np.uint64))))


def _hashes(letters: np.ndarray) -> np.ndarray:
    return (letters.astype(np.uint64) * _powers(letters.shape[1])[:-1]).sum(axis=1, dtype=np.uint64)


def _places(hashes: np.ndarray, factor: int, bits: int) -> np.ndarray:
    return (hashes * np.uint64(factor)) >> np.uint64(64 - (bits.bit_length() - 1))


def _slices(hashes: np.ndarray, slices: int) -> np.ndarray:
    return (hashes ^ (hashes >> np.uint64(29))) % np.uint64(slices)


def _bits_of(bits: int, slices: int):
    """A function of batches of words: (slice, block, bit) for the two places of each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, letters in _by_length(batch.column("word")):
                h = _hashes(letters)
                of = np.tile(_slices(h, slices), len(FACTORS)).astype(np.int32)
                at = np.concatenate([_places(h, f, bits) for f in FACTORS])
                yield pa.record_batch([pa.array(of), pa.array((at // BLOCK).astype(np.int32)), pa.array((at % BLOCK).astype(np.int32))], ["slice", "block", "bit"])

    return run


def _block(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block of the bitmap from its bits."""
    out = np.zeros(BLOCK, bool)
    for batch in batches:
        out[batch.column(batch.schema.get_field_index("bit")).to_numpy()] = True
    yield pa.record_batch([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()), pa.array([np.packbits(out, bitorder="little").tobytes()], pa.binary())], ["slice", "block", "bits"])


class Neighbours:
    """Spells out those neighbours of words that the bitmap of one slice of the vocabulary lets pass."""

    def __init__(self, alphabet: bytes, bits: int, slices: int, slice_: int, bitmap) -> None:
        self.alphabet, self.bits, self.slices, self.slice, self.bitmap = alphabet, bits, slices, slice_, bitmap

    def maybe(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of the hashes, in flat order, that may be words."""
        bitmap, at = self.table, None
        flat = hashes.ravel()
        for factor in FACTORS:
            now = _places(flat if at is None else flat[at], factor, self.bits)
            hit = np.flatnonzero(bitmap[now >> np.uint64(3)] >> (now & np.uint64(7)).astype(np.uint8) & np.uint8(1))
            at = hit if at is None else at[hit]
        return at[_slices(flat[at], self.slices) == self.slice] if self.slices > 1 else at

    def of(self, letters: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, neighbours): numbers of words and a matrix with a neighbour of each, for words of one length."""
        m, size = letters.shape
        chars = np.frombuffer(self.alphabet, np.uint8)
        wide, power = chars.astype(np.uint64), _powers(size + 1)
        terms = letters * power[:size]
        before = np.concatenate((np.zeros((m, 1), np.uint64), np.cumsum(terms, axis=1, dtype=np.uint64)), axis=1)
        whole = before[:, -1]
        for i in range(size + 1):
            after = whole - before[:, i]
            if i < size:
                # of equal letters in a row only the first is deleted, so that no deletion comes twice
                own = np.flatnonzero(letters[:, i] != letters[:, i - 1]) if i else np.arange(m)
                rows = own[self.maybe((before[own, i] + (after[own] - terms[own, i]) * np.uint64(INVERSE)))]
                yield rows, np.delete(letters[rows], i, axis=1)
                found = self.maybe((whole - terms[:, i])[:, None] + wide * power[i])
                rows, c = found // len(chars), chars[found % len(chars)]
                other = c != letters[rows, i]
                rows = rows[other]
                out = letters[rows]
                out[:, i] = c[other]
                yield rows, out
            found = self.maybe((before[:, i] + after * np.uint64(BASE))[:, None] + wide * power[i])
            rows, c = found // len(chars), chars[found % len(chars)]
            if i:  # a letter beside its equal is inserted before it only
                other = c != letters[rows, i - 1]
                rows, c = rows[other], c[other]
            yield rows, np.insert(letters[rows], i, c, axis=1)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        self.table = self.bitmap.value
        step = max(1, CELLS // max(1, len(self.alphabet)))
        for batch in batches:
            column = batch.column("word")
            for numbers, letters in _by_length(column):
                for a in range(0, len(numbers), step):
                    for rows, out in self.of(letters[a : a + step]):
                        if len(rows):
                            width = out.shape[1]
                            near = [x.decode("latin-1") for x in (out.tobytes()[k * width : (k + 1) * width] for k in range(len(out)))]
                            yield pa.record_batch([column.take(pa.array(numbers[a : a + step][rows])), pa.array(near, pa.string())], ["word", "near"])


def alphabet_of(vocabulary: DataFrame) -> bytes:
    """The letters of all words, 256 at most."""
    letters = vocabulary.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).where("c <> ''").distinct()
    return bytes(sorted(ord(r.c) for r in letters.collect()))


def near_words(vocabulary: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """(word, near, near_n) of all pairs of a vocabulary (word, n) that differ by one inserted, deleted or replaced letter.

    Words are distinct and of code points below 256. Both orders of a pair are returned. An empty vocabulary has no pairs.
    """
    spark = vocabulary.sparkSession
    only = vocabulary.select("word")
    total, alphabet = only.count(), alphabet_of(vocabulary)
    bits = min(most_bits, max(BLOCK, 1 << (max(1, total * BITS_EACH) - 1).bit_length()))
    slices = max(1, math.ceil(total * BITS_EACH / 2 / bits))
    marks = only.mapInArrow(_bits_of(bits, slices), "slice int, block int, bit int")
    marks = stored(marks.groupBy("slice", "block").applyInArrow(_block, "slice int, block int, bits binary"), "word-bits")
    parts = []
    for k in range(slices):
        bitmap = np.zeros(bits // 8, np.uint8)
        for row in marks.where(F.col("slice") == k).toLocalIterator():  # at most `most_bits` bits
            bitmap[row.block * (BLOCK // 8) : (row.block + 1) * (BLOCK // 8)] = np.frombuffer(row.bits, np.uint8)
        # the words come in as many parts as cores like, since each brings a thousand neighbours
        spread = only.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), "word")
        parts.append(spread.mapInArrow(Neighbours(alphabet, bits, slices, k, spark.sparkContext.broadcast(bitmap)), "word string, near string"))
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    return found.join(vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near").select("word", "near", "near_n")


def variants(vocabulary: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for each row of a vocabulary (word, n) of distinct words.

    A word's form is its near word of largest n, the smallest in code-point order among equals, if that n is `ratio` times
    the word's or more, else null. Its root is the last word that forms lead to, or itself.
    """
    order = F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("near"))
    best = near_words(vocabulary).groupBy("word").agg(F.count("*").alias("n_near"), F.min(order).alias("best"))
    form_n = -F.col("best.minus")
    rows = vocabulary.join(best, "word", "left")
    found = stored(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), *(F.when(form_n >= F.col("n") * ratio, c).alias(name) for c, name in ((F.col("best.near"), "form"), (form_n, "form_n")))), "word-forms")
    return found.join(_roots(found, ratio), "word", "left").withColumn("root", F.coalesce("root", "word"))


def _roots(forms: DataFrame, ratio: int) -> DataFrame:
    """(word, root) of the words with a form: links are doubled as often as the longest chain of growing n can need."""
    links = forms.where("form is not null").select("word", F.col("form").alias("root"))
    most = forms.agg(F.max("n")).first()[0] or 1
    for _ in range(int(math.log(most, max(2, ratio)) + 1).bit_length()):
        links = links.join(links.toDF("root", "next"), "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    return links


def op11_spelling_variants(spark, sf_dir: str) -> DataFrame:
    """The contract's rows over the whole `documents` table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return variants(stored(words(docs), "words")).select("word", "form", "root", "n", "n_near", "form_n")


OP11_SQL = """with steps as (
  select list(c order by i) as tab from (
    select i, list_reduce([i::bigint, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end) as c from range(256) t(i))),
runs as (select doc_id, run, count(*) as n from (
  select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{00C0}-\\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run from documents)
  where length(run) >= 7 group by all),
hexed as (select run, n, hex(encode(coalesce(cast(doc_id as varchar), '') || ':' || run)) as x from runs),
summed as (select run, n, xor(4294967295, list_reduce(list_concat([4294967295::bigint], list_transform(range(length(x) // 2), lambda k: ('0x' || substr(x, 2 * k + 1, 2))::bigint)),
  lambda c, b: xor(c // 256, tab[xor(c, b) % 256 + 1]))) as h from hexed, steps),
vocab as materialized (select word, sum(n)::bigint as n from (
  select n, case when h % 31 = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word from summed)
  where length(word) >= 7 group by word having sum(n) >= 2),
cut as materialized (select word, i, substr(word, 1, i) || substr(word, i + 2) as short from (select word, unnest(range(length(word))) as i from vocab)),
near as (
  select distinct c.word as word, v.word as near from cut c join vocab v on v.word = c.short
  union select v.word, c.word from cut c join vocab v on v.word = c.short
  union select a.word, b.word from cut a join cut b on a.i = b.i and a.short = b.short and a.word <> b.word),
ranked as (select near.word, near.near, n as near_n, count(*) over (partition by near.word) as n_near, row_number() over (partition by near.word order by n desc, near.near) as place from near join vocab on vocab.word = near.near),
best as (select * from ranked where place = 1),
forms as materialized (select word, vocab.n, coalesce(n_near, 0) as n_near, case when near_n >= 10 * vocab.n then near end as form, case when near_n >= 10 * vocab.n then near_n end as form_n from vocab left join best using (word)),
chain as (with recursive c(word, last, hops) as (select word, word, 0 from forms union all select c.word, f.form, hops + 1 from c join forms f on f.word = c.last where f.form is not null) select word, arg_max(last, hops) as root from c group by word)
select word, form, root, n, n_near, form_n from forms join chain using (word)"""
