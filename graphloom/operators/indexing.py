"""Documents to stored chunks: extract, clean, chunk, insert, each stage with its rows and seconds."""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom.operators import chunk
from graphloom.operators.components import ensure_checkpoints

Stage = Callable[[DataFrame], DataFrame]


def input_fingerprint(rows: DataFrame) -> str:
    """Stands for the files that rows are read from: their names, sizes and times of change."""
    spark = rows.sparkSession

    def state(path: str) -> str:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        status = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hadoop)
        return f"{path} {status.getLen()} {status.getModificationTime()}"

    return hashlib.sha256("\n".join(sorted(map(state, rows.inputFiles()))).encode()).hexdigest()


def staged(rows: DataFrame, stages: list[tuple], folder: str | None = None, fingerprint: str | None = None) -> tuple[DataFrame, list[dict]]:
    """The last stage's rows, and (stage, rows, seconds, reused) of each: a stage's result is stored and counted while it is written.

    A stage is (name, function) or (name, function, parameters). With a `folder` a run can be resumed: each stage lies there
    under the hash of the input's `fingerprint` (by default that of its files), and of the names and parameters up to it.
    A later run with the same ones takes up what is whole, as Spark's own mark says, and begins after it; a stage that broke
    off is written anew, and a changed parameter or input renews all stages from there on. Functions are known by their
    names and parameters alone, so one that changed needs another name. Without a `folder` each run has its own.
    """
    spark, metrics = rows.sparkSession, []
    if folder is None:
        ensure_checkpoints(spark)
        folder, chain = f"{spark.sparkContext.getCheckpointDir()}/stages-{uuid.uuid4().hex}", ""
    else:
        chain = input_fingerprint(rows) if fingerprint is None else fingerprint
    for name, stage, *parameters in stages:
        chain = hashlib.sha256(repr((chain, name, parameters)).encode()).hexdigest()
        path, begun = f"{folder}/{name}-{chain[:16]}", time.monotonic()
        marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker):
            rows = spark.read.parquet(path)
            metrics.append({"stage": name, "rows": rows.count(), "seconds": time.monotonic() - begun, "reused": True})
            continue
        seen = Observation(name)
        made = stage(rows).observe(seen, F.count(F.lit(1)).alias("rows"))
        made.write.mode("overwrite").parquet(path)
        metrics.append({"stage": name, "rows": seen.get["rows"], "seconds": time.monotonic() - begun, "reused": False})
        rows = spark.read.schema(made.schema).parquet(path)
    return rows, metrics


def index_documents(docs: DataFrame, insert: Callable[[DataFrame], object], id_col: str = "doc_id", text_col: str = "text", size: int = 1000, overlap: int = 200, extract: Callable[[Column], Column] | None = None, unicode: bool = True, folder: str | None = None) -> tuple[DataFrame, list[dict]]:
    """Runs documents through all stages; `insert` takes the chunks (id_col, chunk_id, chunk), such as `Collections.add` does.

    `extract` makes text of a column of another kind. Documents without text have no chunks. Returns the chunks and the
    stages' metrics, the last of which is the insertion's. With a `folder` a run that broke off is resumed by the next one,
    as `staged` says; the insertion is not remembered, so `insert` is called by each run.
    """
    text = F.col(text_col)
    chunks, metrics = staged(docs, [
        ("extract", lambda df: df.select(id_col, (extract(text) if extract else text).alias("text")), id_col, text_col, getattr(extract, "__qualname__", None)),
        ("clean", lambda df: df.select(id_col, X.clean(F.col("text"), unicode=unicode).alias("text")).where("text <> ''"), unicode),
        ("chunk", lambda df: chunk.strides(df, id_col, "text", size, overlap), size, overlap),
    ], folder)
    begun = time.monotonic()
    insert(chunks)
    return chunks, [*metrics, {"stage": "insert", "rows": metrics[-1]["rows"], "seconds": time.monotonic() - begun, "reused": False}]
