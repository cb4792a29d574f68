"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import itertools
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bits of a bitmap of ids, for each of them, and the limits of their number.
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 1 << 15, 1 << 25


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where that is unset and all of Spark is one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet into the shared folder and read back: its lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def texts_as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text, without decoding; null gives b""."""
    if pa.types.is_null(column.type):
        return [b""] * len(column)
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def pieces_of(batch: pa.RecordBatch, most_bytes: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `most_bytes` of text each, one row at least, so that memory follows bytes and not rows."""
    lens = pa.compute.binary_length(batch.column(column).cast(pa.large_binary())).fill_null(0)
    ends = np.cumsum(lens.to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = [0, *(np.flatnonzero(np.diff(ends // max(1, most_bytes))) + 1).tolist(), batch.num_rows]
    for a, b in itertools.pairwise(cuts):
        if b > a:
            yield batch.slice(a, b - a)


def small_batches(spark: SparkSession, records: int = 1000, most_bytes: int = 8 << 20) -> None:
    """Lowers the session's limits of an Arrow batch, so that texts in flight between JVM and Python stay small; never raises them."""
    for name, most in (("maxRecordsPerBatch", records), ("maxBytesPerBatch", most_bytes)):
        key = f"spark.sql.execution.arrow.{name}"
        now = int(re.search(r"-?\d+", spark.conf.get(key))[0])
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the undirected `edges` (u, v); component is the smallest node.

    Alternates large-star and small-star steps: each is a grouped minimum (combined before its shuffle) and an equi-join,
    so a node with very many edges is never gathered in one task. The lineage is cut by checkpoint() in each round.
    Self-loops, repeated edges and null ends have no effect; no edges give an empty result.
    """
    shared_dir(edges.sparkSession)
    u, v = F.greatest("u", "v"), F.least("u", "v")
    now = edges.where("u is not null and v is not null and u <> v").select(u.alias("a"), v.alias("b")).distinct().checkpoint()
    mark = None
    for _ in range(most_rounds):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("n")).union(now.select("b", "a"))
        low = both.groupBy("u").agg(F.min("n").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("n > u").join(low, "u").select(F.col("n").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        pairs = large.join(least, "a")
        now = pairs.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", "m")).distinct().checkpoint()
        row = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.count_distinct("a")).first()
        if tuple(row) == mark and row[0] == row[2]:
            break
        mark = tuple(row)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b"), F.col("b")).distinct())


def maybe_among(rows: DataFrame, key_col: str, ids: DataFrame) -> DataFrame:
    """`rows` with a column `_maybe`: false only where `key_col` is none of `ids.id`, as a broadcast bitmap of their hashes tells.

    The bitmap has `BITS_EACH` bits for each id and 4 MB at most, in words of 64 bits; beyond that it only lets more rows pass.
    """
    bits = min(MOST_BITS, max(LEAST_BITS, BITS_EACH << max(0, ids.count() - 1).bit_length()))

    def place(x: Column) -> Column:
        return F.pmod(F.xxhash64(x), F.lit(bits).cast("long"))

    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.col("at"), F.lit(64)).cast("int"))
    words = ids.select(place(F.col("id")).alias("at")).groupBy(F.shiftright("at", 6).alias("_maybe_word")).agg(F.bit_or(bit).alias("_maybe_bits"))
    at = place(F.col(key_col))
    joined = rows.withColumn("_maybe_word", F.shiftright(at, 6)).join(F.broadcast(words), "_maybe_word", "left")
    found = F.getbit("_maybe_bits", F.pmod(at, F.lit(64)).cast("int")) == 1
    return joined.withColumn("_maybe", F.coalesce(found, F.lit(False))).drop("_maybe_word", "_maybe_bits")


class Forest:
    """Union-find over 0..n-1 whose roots are the smallest members."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Joins a[i] with b[i] for all i, by hooking larger roots below smaller ones until nothing changes."""
        while len(a):
            a, b = self.roots(a), self.roots(b)
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))

    def roots(self, x: np.ndarray) -> np.ndarray:
        while True:
            y = self.up[x]
            if (y == x).all():
                return y
            self.up[x] = self.up[y]
            x = y
