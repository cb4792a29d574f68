"""Benchmark decontamination by a distributed positional inverted index.

The training table becomes a stored index of segments, each over whole documents of a few MB: sorted terms, and for every
term the list of its word positions. Test windows come in blocks of bounded size. In each segment a window starts from the
list of its rarest term there; that list and those of the next rarer terms, each moved by its offset in the window, are
intersected by binary search until the exact occurrences (or, within a slop, the near ones) are left. No list leaves its
segment, so a passage in a third of all documents costs what its occurrences cost and is never gathered in one task.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import pieces_of, stored, texts_as_bytes

#: Text of a segment, bytes of test windows in a block, candidates that are held at once.
SEGMENT_BYTES, BLOCK_BYTES, AT_ONCE = 4_000_000, 16_000_000, 1_000_000
#: Words that a near match's words may lie from their places, in the query.
SLOP = 1

#: A-Z become lower case; what is not a word's byte becomes a blank. Bytes from 0x80 on belong to words.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Words of digits, letters and non-ASCII characters, A-Z in lower case."""
    return text.translate(_PLAIN).split()


def _packed(x: np.ndarray) -> bytes:
    """int32 values with their bytes in planes, which compress well when differences are small."""
    return np.diff(x.astype("<i4"), prepend=np.int32(0)).view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpacked(x: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(x, np.uint8).reshape(4, -1).T.copy().view("<i4").ravel(), dtype=np.int64)


def _index(gap: int, schema: pa.Schema, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of (id, text) rows; documents lie `gap` positions apart, so no match crosses from one into the next."""
    part, n = TaskContext.get().partitionId(), 0
    for batch in batches:
        for rows in pieces_of(batch, SEGMENT_BYTES):
            vocabulary: dict[bytes, int] = {}
            number, terms, lens = functools.partial(_numbered, vocabulary), [], []
            for text in texts_as_bytes(rows.column("text")):
                found = number(words_of(text))
                terms += found
                lens.append(len(found))
            sizes = np.array(lens, np.int64)
            starts = np.cumsum(sizes + gap) - (sizes + gap)
            of = np.array(terms, np.int64)
            at = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(of))
            order = np.argsort(of, kind="stable")
            counts = np.bincount(of, minlength=len(vocabulary))
            yield pa.record_batch([pa.array([f"{part}-{n}"]), pa.array([rows.column("id").to_pylist()], schema.field("ids").type), pa.array([_packed(sizes)], pa.binary()), pa.array([b" ".join(vocabulary)], pa.binary()), pa.array([_packed(counts)], pa.binary()), pa.array([_packed(at[order])], pa.binary())], schema=schema)
            n += 1


def _numbered(vocabulary: dict[bytes, int], words: list[bytes]) -> list[int]:
    put = vocabulary.setdefault
    return [put(w, len(vocabulary)) for w in words]


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gap: int = 64) -> DataFrame:
    """The stored segments of all documents: (segment, ids, sizes, terms, counts, positions)."""
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("segment", T.StringType()), T.StructField("ids", T.ArrayType(kind)), *(T.StructField(x, T.BinaryType()) for x in ("sizes", "terms", "counts", "positions"))])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return stored(rows.mapInArrow(lambda batches: _index(gap, arrow, batches), schema), "postings")


class Segment:
    """One segment's lists: positions sorted by (term, position)."""

    def __init__(self, sizes: bytes, terms: bytes, counts: bytes, positions: bytes, gap: int) -> None:
        self.sizes = _unpacked(sizes)
        self.starts = np.cumsum(self.sizes + gap) - (self.sizes + gap)
        self.span = int((self.sizes + gap).sum()) + 1
        self.terms = {w: k for k, w in enumerate(terms.split())}
        self.counts = _unpacked(counts)
        self.heads = np.cumsum(self.counts) - self.counts
        self.at = _unpacked(positions)
        self.keys = np.repeat(np.arange(len(self.counts)), self.counts) * self.span + self.at

    def holds(self, term: np.ndarray, place: np.ndarray, slop: int) -> np.ndarray:
        """Whether each term has a position within `slop` of its place."""
        want = term * self.span + place
        found = np.searchsorted(self.keys, want - slop)
        found[found == len(self.keys)] = 0
        near = self.keys[found]
        return (near >= want - slop) & (near <= want + slop) & (near // self.span == term)

    def matches(self, block: TestBlock, slop: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(window, start, position of one of its words) of all occurrences whose words lie in order, or within `slop` of their places.

        A start fits if each word of the window has a position within `slop` of its own place from there, so it does not
        matter which word the search begins with.
        """
        local = np.array([self.terms.get(w, -1) for w in block.vocabulary] + [-2], np.int64)
        term = local[block.words]  # -1: not in this segment, -2: past a short window's end
        alive = np.flatnonzero((term != -1).all(axis=1)) if len(self.at) else np.zeros(0, np.int64)
        if not len(alive):
            return
        term = term[alive]
        counts = np.where(term >= 0, self.counts[term], np.iinfo(np.int64).max)
        order = np.argsort(counts, axis=1, kind="stable")
        term, counts = np.take_along_axis(term, order, 1), np.take_along_axis(counts, order, 1)
        shifts = np.arange(-slop, slop + 1)
        groups = np.cumsum(counts[:, 0] * len(shifts)) // AT_ONCE
        for rows in np.split(np.arange(len(alive)), np.flatnonzero(np.diff(groups)) + 1):
            n = counts[rows, 0]
            row = np.repeat(rows, n)
            found = self.at[np.repeat(self.heads[term[rows, 0]] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            row, found = np.repeat(row, len(shifts)), np.repeat(found, len(shifts))
            start = found - order[row, 0] + np.tile(shifts, n.sum())
            for k in range(1, term.shape[1]):
                there = term[row, k]
                keep = there < 0
                some = np.flatnonzero(~keep)
                keep[some] = self.holds(there[some], start[some] + order[row[some], k], slop)
                row, start, found = row[keep], start[keep], found[keep]
            yield alive[row], start, found


class TestBlock:
    """Test windows of bounded size: words as numbers of a vocabulary, padded by its length, and the items of each window."""

    def __init__(self, rows: list[tuple[bytes, list[str]]], width: int) -> None:
        numbers: dict[bytes, int] = {}
        found = [_numbered(numbers, bytes(words).split()) for words, _ in rows]
        self.vocabulary = list(numbers)
        self.words = np.full((len(found), width), len(numbers), np.int64)
        for k, x in enumerate(found):
            self.words[k, : len(x)] = x
        self.sizes = np.array([len(x) for x in found], np.int64)
        self.items = [items for _, items in rows]


def _windows(width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, out = [], []
        for item, text in zip(batch.column(0).to_pylist(), texts_as_bytes(batch.column(1)), strict=True):
            words = words_of(text)
            for k in range(max(min(len(words), 1), len(words) - width + 1)):
                ids.append(item)
                out.append(b" ".join(words[k : k + width]))
        yield pa.record_batch([pa.array(ids, pa.string()), pa.array(out, pa.binary())], ["item", "words"])


def test_blocks(items: DataFrame, width: int, id_col: str = "item_id", text_col: str = "text", most_bytes: int = BLOCK_BYTES) -> Iterator[TestBlock]:
    """The distinct windows of all items, dealt by hash into as many blocks as keep each near `most_bytes`."""
    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).cast("string").alias("text"))
    found = stored(rows.mapInArrow(lambda batches: _windows(width, batches), "item string, words binary").distinct(), "test-windows")
    size = found.agg(F.sum(F.octet_length("words") + F.octet_length("item") + 64)).first()[0] or 0
    n = -(-size // most_bytes)
    for k in range(n):
        part = found.where(F.pmod(F.xxhash64("words"), F.lit(n)) == k)
        yield TestBlock([(r[0], r[1]) for r in part.groupBy("words").agg(F.collect_list("item")).collect()], width)


def _found(block: TestBlock | None, gap: int, slop: int, schema: pa.Schema, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            segment = Segment(row["sizes"], row["terms"], row["counts"], row["positions"], gap)
            n = len(segment.sizes)
            edge = np.zeros(segment.span + 1, np.int64)
            exact: list[set[str]] = [set() for _ in range(n)]
            near: list[set[str]] = [set() for _ in range(n)]
            for most, into in ((0, exact), (slop, near))[: 2 if slop else 1]:
                for window, start, found in segment.matches(block, most) if block else ():
                    doc = np.searchsorted(segment.starts, found, "right") - 1
                    if into is exact:
                        np.add.at(edge, start, 1)
                        np.add.at(edge, start + block.sizes[window], -1)
                    for pair in np.unique(np.maximum(doc, 0) * len(block.items) + window).tolist():
                        into[pair // len(block.items)].update(block.items[pair % len(block.items)])
            hit = np.diff((np.cumsum(edge) > 0).astype(np.int8), prepend=np.int8(0))
            first, last = np.flatnonzero(hit == 1), np.flatnonzero(hit == -1)
            doc = np.searchsorted(segment.starts, first, "right") - 1
            spans: list[list[dict]] = [[] for _ in range(n)]
            for d, a, b in zip(doc.tolist(), (first - segment.starts[doc]).tolist(), (last - segment.starts[doc]).tolist(), strict=True):
                spans[d].append({"start": a, "end": b})
            n_hit = np.bincount(doc, (last - first).astype(float), minlength=n).astype(np.int64)
            yield pa.record_batch([pa.array([row["segment"]] * n), pa.array(range(n), pa.int32()), pa.array(row["ids"], schema.field("id").type), pa.array(segment.sizes), pa.array(n_hit), pa.array([sorted(x) for x in exact], schema.field("items").type), pa.array(spans, schema.field("spans").type), pa.array([sorted(a - b) for a, b in zip(near, exact, strict=True)], schema.field("near_items").type)], schema=schema)


def contamination(docs: DataFrame, items: DataFrame, width: int = 10, slop: int = 0, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each row of `docs`: (id_col, n_words, n_hit, items, spans, near_items).

    A window is `width` consecutive words of an item, or all of a shorter item's. n_hit counts the document's words inside
    any occurrence; spans are their [start, end) in words; items have an exact occurrence; near_items have none, but a
    place where each word of a window lies up to `slop` words from where it should. Null and empty texts have no words; an item without words has no
    windows; an item without an id counts as "". Repeated rows give repeated results, repeated items count once; an empty
    table of documents gives no rows and one of items gives rows without hits. Other columns are not read.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    gap = width + 2 * slop + 1
    index = build_index(docs, id_col, text_col, gap)
    schema = T.StructType([T.StructField("segment", T.StringType()), T.StructField("nth", T.IntegerType()), T.StructField("id", docs.schema[id_col].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("near_items", T.ArrayType(T.StringType()))])
    arrow = to_arrow_schema(schema)
    parts = []
    for block in test_blocks(items, width, item_col, most_bytes=block_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(block)
        parts.append(index.mapInArrow(lambda batches, sent=sent: _found(sent.value, gap, slop, arrow, batches), schema))
    if not parts:
        parts = [index.mapInArrow(lambda batches: _found(None, gap, slop, arrow, batches), schema)]
    if len(parts) == 1:
        return parts[0].select(F.col("id").alias(id_col), "n_words", "n_hit", "items", "spans", "near_items")
    merged = functools.reduce(DataFrame.union, parts).groupBy("segment", "nth").agg(F.first("id").alias(id_col), F.first("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("s"), F.array_distinct(F.flatten(F.collect_list("near_items"))).alias("near"))
    empty = F.expr("cast(array() as array<struct<start: bigint, end: bigint>>)")

    def add(done, x):
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= x["start"]), joined).otherwise(F.concat(done, F.array(x)))

    merged = merged.withColumn("spans", F.aggregate("s", empty, add))
    hits = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return merged.select(id_col, "n_words", hits.alias("n_hit"), "items", "spans", F.array_sort(F.array_except("near", "items")).alias("near_items"))


def op2_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """The contract's rows over the whole `documents` and `benchmark` tables, and the items that only occur within `SLOP` words."""
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), slop=SLOP)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), F.size("near_items").cast("long").alias("n_near"), F.sha2(F.array_join("near_items", ","), 256).alias("near_sha256"))


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Rows of `docs` in which no window of any item occurs; same columns. Rows that share a doc_id go together."""
    found = contamination(docs, items).where("n_hit > 0").select(F.col("doc_id").alias("_hit_id")).distinct()
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col("_hit_id")), "left_anti")


OP2_SQL = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
bw as (select distinct item_id, least(len(w), 10) as n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') as s
       from (select item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) as i from b where len(w) > 0)),
dw as (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as s
       from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, (select distinct n from bw) as sizes where len(w) >= n)),
h as (select doc_id, i, dw.n, item_id from dw join bw on dw.n = bw.n and dw.s = bw.s),
hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from h) group by doc_id),
it as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, cast(item_id as varchar) as item from h) group by doc_id),
dp as (select doc_id, w, p, w[p] as word from (select doc_id, w, unnest(range(1, len(w) + 1)) as p from d)),
df as (select word, count(*) as n from dp group by word),
nw as (select distinct item_id, v, k, v[k] as word from (select item_id, v, unnest(range(1, len(v) + 1)) as k from (select item_id, string_split(s, ' ') as v from bw))),
anchor as (select item_id, v, arg_min(k, coalesce(n, 0)) as k, arg_min(word, coalesce(n, 0)) as word, min(coalesce(n, 0)) as n from nw left join df using (word) group by item_id, v having min(coalesce(n, 0)) > 0),
near as (select distinct doc_id, cast(item_id as varchar) as item from (select doc_id, w, v, item_id, p - k + shift as s from dp join anchor using (word), (values (-1), (0), (1)) as t(shift))
         where len(list_filter(range(1, len(v) + 1), lambda i: list_contains(w[greatest(s + i - 1, 1):s + i + 1], v[i]))) = len(v)),
ni as (select doc_id, count(*) as n_near, string_agg(item, ',' order by item) as items from near where (doc_id, item) not in (select doc_id, cast(item_id as varchar) from h) group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
       sha256(coalesce(it.items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated, cast(coalesce(n_near, 0) as bigint) as n_near, sha256(coalesce(ni.items, '')) as near_sha256
from d left join hit using (doc_id) left join it using (doc_id) left join ni using (doc_id)
"""
