"""SimHash near-dedup over a Gray-order hierarchical index.

Texts become 64-bit fingerprints. Two fingerprints that differ in at most three of 64 bits agree on at least one of four
16-bit blocks, and so on the first bits of one, so every fingerprint is dealt to the four buckets of as many first bits of
its blocks as leave some thousand members to a bucket; buckets with too many members are dealt further by sub-blocks of
their other bits, which loses no pair either. A task sorts its fingerprints by bucket and Gray
rank, factors the bits that neighbours share into masked patterns of upper nodes, and walks the tree from each bucket's
root for all fingerprints at once: differences are added up level by level, and a whole group goes as soon as the sum is
over the limit. Components are then joined over the distinct fingerprints only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import Forest, connected_components, stored, texts_as_bytes

SEED = 42
BITS = 64
#: Members that a bucket should have, and from which it is dealt further; children of an index node, fingerprints whose walks go together.
BUCKET, HOT_BUCKET, FANOUT, BLOCK = 1_000, 20_000, 8, 1024
#: Bytes of a text that are split into words at once, and shingles that are held.
HELD_BYTES, HELD_SHINGLES = 1_000_000, 60_000


_BLANK = re.compile(rb"[ \t\n\r\x0b\f]")


def _word_runs(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text in runs; a long text is cut at blanks to be read."""
    at = 0
    while at < len(text):
        end = _BLANK.search(text, at + HELD_BYTES) if len(text) - at > HELD_BYTES else None
        upto = end.start() if end else len(text)
        yield text[at:upto].split()
        at = upto


def shingle_hashes(text: bytes, width: int) -> Iterator[list[int]]:
    """XXH64 of each run of `width` words of the lower-cased text, or of all words if there are fewer, in parts."""
    h, held, some = xxhash.xxh64_intdigest, [], False
    for run in _word_runs(text.lower()):
        words = held + run
        if len(words) >= width:
            some = True
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            starts = np.concatenate(([0], ends[:-width]))
            yield [h(joined[a:b], SEED) for a, b in zip(starts.tolist(), (ends[width - 1 :] - 1).tolist(), strict=True)]
        held = words[max(0, len(words) - width + 1) :]
    if held and not some:
        yield [h(b" ".join(held), SEED)]


def fingerprints_of(texts: list[bytes], width: int = 3) -> np.ndarray:
    """int64 fingerprints; a bit is set if it is set in over half of a text's shingle hashes."""
    ones, n = np.zeros((len(texts), BITS), np.int32), np.zeros(len(texts), np.int64)
    held: list[int] = []
    parts: list[tuple[int, int]] = []

    def flush() -> None:
        if held:
            bits = np.unpackbits(np.array(held, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            of, lens = np.array(parts).T
            np.add.at(ones, of, np.add.reduceat(bits, np.cumsum(lens) - lens, axis=0, dtype=np.int32))
            np.add.at(n, of, lens)
        held.clear()
        parts.clear()

    for i, text in enumerate(texts):
        for found in shingle_hashes(text, width):
            held += found
            parts.append((i, len(found)))
            if len(held) > HELD_SHINGLES:
                flush()
    flush()
    return np.packbits(2 * ones > n[:, None], axis=1, bitorder="little").view("<u8").ravel().view(np.int64)


def fingerprint(text: Column, width: int = 3) -> Column:
    """The fingerprint as a long; null and empty texts give 0."""

    @F.arrow_udf("long")
    def simhash(column: pa.Array) -> pa.Array:
        return pa.array(fingerprints_of(texts_as_bytes(column), width))

    return simhash(text)


def gray_rank(x: Column) -> Column:
    """Place of a bit pattern in the Gray sequence."""
    for k in (1, 2, 4, 8, 16, 32):
        x = x.bitwiseXOR(F.shiftrightunsigned(x, k))
    return x


def index_levels(bucket: np.ndarray, codes: np.ndarray, fanout: int) -> list[tuple[np.ndarray, ...]]:
    """From the leaves up: (first child, end of children, shared bits' mask, their pattern, bucket) of every node; one root per bucket."""
    n = len(codes)
    first, end, ands, ors, of = np.arange(n), np.arange(1, n + 1), codes, codes, bucket
    levels = [(first, end, ~(ands ^ ors), ands, of)]
    while True:
        change = np.flatnonzero(np.diff(of)) + 1
        heads = np.concatenate(([0], change))
        if len(heads) == len(of):
            return levels
        within = np.arange(len(of)) - np.repeat(heads, np.diff(np.concatenate((heads, [len(of)]))))
        first = np.flatnonzero(within % fanout == 0)
        end = np.concatenate((first[1:], [len(of)]))
        ands, ors, of = np.bitwise_and.reduceat(ands, first), np.bitwise_or.reduceat(ors, first), of[first]
        levels.append((first, end, ~(ands ^ ors), ands, of))


def close_pairs(bucket: np.ndarray, codes: np.ndarray, most: int, fanout: int = FANOUT, block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions in one bucket whose codes differ in `most` bits at most, each once, or pairs that chain such a group.

    `bucket` is sorted; codes are distinct within a bucket and should be in Gray order there.
    """
    if not len(codes):
        return
    levels = index_levels(bucket, codes, fanout)
    reach = [np.arange(1, len(codes) + 1)]  # end of the leaves below each node
    for first, end, *_ in levels[1:]:
        reach.append(reach[-1][end - 1])
    roots = levels[-1][4]
    for a in range(0, len(codes), block):
        b = min(len(codes), a + block)
        query, node = np.arange(a, b), np.searchsorted(roots, bucket[a:b])
        spent, known = np.zeros(b - a, np.int64), np.zeros(b - a, np.uint64)
        for depth in range(len(levels) - 1, -1, -1):
            first, end, mask, pattern, _ = levels[depth]
            spent = spent + np.bitwise_count((codes[query] ^ pattern[node]) & mask[node] & ~known)
            keep = (spent <= most) & (reach[depth][node] > query + 1)
            query, node, spent = query[keep], node[keep], spent[keep]
            known = mask[node]
            if depth == 0:
                ahead = node > query
                yield query[ahead], node[ahead]
                break
            n = end[node] - first[node]
            at = np.repeat(first[node] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            query, node, spent, known = np.repeat(query, n), at, np.repeat(spent, n), np.repeat(known, n)


def _link(most: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, code) sorted by bucket in; a star of each bucket's linked codes out."""

    def stars(bucket: np.ndarray, codes: np.ndarray) -> pa.RecordBatch:
        forest = Forest(len(codes))
        for a, b in close_pairs(bucket, codes, most):
            forest.link(a, b)
        root = forest.roots(np.arange(len(codes)))
        apart = root != np.arange(len(codes))
        values = codes.view(np.int64)
        return pa.record_batch([pa.array(values[apart]), pa.array(values[root[apart]])], ["u", "v"])

    kept: list[np.ndarray] = [np.zeros(0, np.int64), np.zeros(0, np.uint64)]
    for batch in batches:
        bucket, codes = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
        kept = [np.concatenate((kept[0], bucket)), np.concatenate((kept[1], codes))]
        cut = int(np.searchsorted(kept[0], kept[0][-1])) if len(kept[0]) > 30_000 else 0
        if cut:
            yield stars(kept[0][:cut], kept[1][:cut])
            kept = [kept[0][cut:], kept[1][cut:]]
    if len(kept[0]):
        yield stars(*kept)


def _blocks(code: Column, parts: int, width: int, total: int, first: int = BITS) -> Column:
    """Array of structs (part, value): the `total` low bits of `code` in `parts` runs of `width` bits, the last with the rest, or the `first` bits of each."""
    cut = []
    for k in range(parts):
        n = width if k < parts - 1 else total - k * width
        cut.append(F.struct(F.lit(k).alias("part"), F.shiftrightunsigned(code, k * width).bitwiseAND((1 << min(n, first)) - 1).alias("value")))
    return F.array(*cut)


def links(codes: DataFrame, most: int = 3, hot: int = HOT_BUCKET, bucket: int = BUCKET) -> DataFrame:
    """Edges (u, v) that connect whatever distinct values of `codes.code` are chained by at most `most` differing bits.

    A bucket holds the codes that agree on the first bits of one of most+1 blocks: as many as deal about `bucket` codes to
    each bucket if they are spread evenly, or whole blocks. One of over `hot` codes is dealt again by most+1 runs of
    the bits outside its block: two codes within the limit agree on one of these runs as well, so no pair is lost.
    """
    parts = most + 1
    width = BITS // parts
    rest = BITS - width
    first = min(width, max(1, (codes.count() // bucket).bit_length()))
    dealt = codes.select("code", F.explode(_blocks(F.col("code"), parts, width, BITS, first)).alias("b"))
    dealt = dealt.select("code", F.col("b.part").alias("part"), F.xxhash64("b.part", "b.value").alias("bucket"))
    full = dealt.groupBy("bucket").count().where(F.col("count") > hot).select("bucket").checkpoint()
    if not full.isEmpty():
        outside = F.lit(None).cast("long")
        for k in range(parts):
            above = F.shiftleft(F.shiftrightunsigned("code", (k + 1) * width), k * width) if k < parts - 1 else F.lit(0)
            below = F.col("code").bitwiseAND((1 << (k * width)) - 1)
            outside = F.when(F.col("part") == k, above.bitwiseOR(below)).otherwise(outside)
        runs = F.explode(_blocks(outside, parts, rest // parts, rest)).alias("b")
        finer = dealt.join(full, "bucket", "left_semi").select("code", "bucket", runs)
        finer = finer.select("code", F.xxhash64("bucket", "b.part", "b.value").alias("bucket"))
        dealt = dealt.join(full, "bucket", "left_anti").select("code", "bucket").union(finer)
    n = int(codes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = dealt.select("bucket", "code").repartition(n, "bucket").sortWithinPartitions("bucket", gray_rank(F.col("code")))
    return placed.mapInArrow(lambda batches: _link(most, batches), "u long, v long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 3, width: int = 3, hot: int = HOT_BUCKET) -> DataFrame:
    """(id_col, fingerprint long, component_id) for every row of `docs`.

    component_id is the smallest id reachable over links. Null and empty texts have fingerprint 0 and link like others;
    repeated rows give repeated results; a component whose ids are all null has a null component_id; an empty table gives
    an empty one. Other columns of `docs` are never read, so their names cannot clash.
    """
    prints = stored(docs.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col), width).alias("code")), "simhash")
    least = stored(prints.groupBy("code").agg(F.min("id").alias("least")), "simhash-codes")
    groups = connected_components(links(least.select("code"), most, hot))
    named = least.join(groups.withColumnRenamed("node", "code"), "code", "left").select("code", "least", F.coalesce("component", "code").alias("component"))
    lowest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_code = named.join(lowest, "component").select("code", "component_id")
    return prints.join(by_code, "code").select(F.col("id").alias(id_col), F.col("code").alias("fingerprint"), "component_id")


def op7_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """The contract's rows over the whole `documents` table."""
    found = simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """Rows of `docs` whose doc_id is the smallest of its near-duplicates; same columns.

    Rows that repeat a doc_id and a fingerprint leave one; other texts of the same doc_id stay if it is the smallest of
    their own near-duplicates as well. Rows without a doc_id are kept: nothing names a survivor for them.
    """
    found = simhash_components(docs).where("doc_id = component_id").select(F.col("doc_id").alias("_kept_id"), F.col("fingerprint").alias("_kept_code")).distinct()
    kept = docs.join(found.select("_kept_id").distinct(), F.col("doc_id") == F.col("_kept_id"), "left_semi")
    if found.groupBy("_kept_id").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id"])
    else:
        own = kept.withColumn("_own_code", fingerprint(F.col("text"), 3))
        same = (F.col("doc_id") == F.col("_kept_id")) & (F.col("_own_code") == F.col("_kept_code"))
        kept = own.join(found, same, "left_semi").dropDuplicates(["doc_id", "_own_code"]).select(docs.columns)
    return kept.union(docs.where("doc_id is null")).select(docs.columns)
