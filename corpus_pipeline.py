"""From raw documents to token ids: each stage calls one operator of graphloom.llm.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of `documents`. Each works
on whatever its predecessor kept, and its decisions take effect in what it returns. Empty tables pass through all stages,
null texts count as empty ones, and further columns are kept up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import decontaminate, line_dedup, quality, sentencepiece_codec, simhash
from graphloom.llm.common import stored


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated quality is below 0.7 go; repeated rows have one score and go or stay together."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows go, and documents of which nothing is left by that; the smallest doc_id keeps its lines."""
    return line_dedup.drop_repeated_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that with the smallest doc_id; rows without one stay too."""
    return simhash.keep_one_of_each(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go; rows that share a doc_id go together."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, text, token_ids, decoded, round_trip) of all documents that are left: ids, their text, and whether it is the same."""
    found = sentencepiece_codec.with_token_ids(docs.select("doc_id", "text")).withColumn("decoded", sentencepiece_codec.decode(F.col("token_ids")))
    return found.withColumn("round_trip", F.col("decoded") == F.coalesce("text", F.lit("")))


STAGES = [
    ("quality classifier", quality_filter),
    ("line dedup", repeated_lines),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark_passages),
    ("SentencePiece encoding and decoding", token_ids),
]

#: The classifier, the fingerprints and the encoding are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is written as Parquet and read as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{k}")
    return docs
