"""Readers and writers: logs, splits, texts, chunks and collections."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: File types by extension; what is not listed is unknown.
FILE_TYPES = {
    "text": ".txt .md .rst .log .csv .json .xml .yaml .yml .css .ini .cfg .toml",
    "pdf": ".pdf",
    "image": ".png .jpg .jpeg .tiff .tif .bmp .webp",
    "html": ".html .htm",
    "docx": ".docx .doc",
    "pptx": ".pptx .ppt",
    "xlsx": ".xlsx .xls",
    "code": ".py .js .ts .jsx .tsx .java .c .cpp .cxx .cc .h .hpp .cs .go .rs .rb .php .scala .kt .swift .r .m .mm .lua .pl .pm .sh .bash .zsh .fish .ps1 .bat .cmd .clj .cljs .ex .exs .erl .hrl .hs .lhs .ml .mli .fs .fsi .fsx .vb .pas .pp .inc .asm .s .sql .elm .nim .cr .d .dart .groovy .jl .lisp .scm .rkt .tcl .v .sv .svh .vhd .vhdl .cob .cbl .tex",
}
#: What may be uploaded, and its largest size.
UPLOADS, UPLOAD_BYTES = (".pdf", ".txt", ".md", ".docx"), 50 * 1024 * 1024

CALL = "struct<id: string, type: string, function: struct<name: string, arguments: string>>"


def trajectory_schema() -> str:
    """The schema of a question's log."""
    return f"question string, answer_indices array<bigint>, time_taken double, trajectories array<struct<message_history: array<struct<role: string, content: string, reasoning_content: string, tool_call_id: string, tool_calls: array<{CALL}>>>, agent_answer_indices: array<bigint>, steps: int, step_times: array<double>>>"


def file_type(name: Column) -> Column:
    from graphloom.functions.text import extension

    pairs = [x for kind, exts in FILE_TYPES.items() for ext in exts.split() for x in (F.lit(ext), F.lit(kind))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), extension(name)), F.lit("unknown"))


def upload_error(name: Column, size: Column) -> Column:
    """Why a file may not be uploaded; null if it may."""
    from graphloom.functions.text import extension

    return F.when(~extension(name).isin(*UPLOADS), "type").when(size > UPLOAD_BYTES, "size")


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """One row for each JSON log of a question, with `file` (its name without extension) and `modified`, by time; corrupt ones are passed over."""
    schema = f"{trajectory_schema()}, _corrupt string"
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    rows = rows.withColumns({"file": F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", ""), "modified": F.col("_metadata.file_modification_time")})
    return rows.where("_corrupt is null").drop("_corrupt").orderBy("modified", "file")


def write_logs(logs: DataFrame, path: str, key: str = "file") -> None:
    """Appends logs by key; keys that are there already are not written again."""
    try:
        done = logs.sparkSession.read.json(path).select(F.col(key).cast("string").alias(key)).distinct()
        logs = logs.join(done, key, "left_anti")
    except Exception as error:  # the folder may not be there, or be empty
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
    logs.write.mode("append").partitionBy(key).json(path)


def read_questions(spark: SparkSession, questions: str, split: str | None = None, limit: int | None = None) -> DataFrame:
    """(id, query, answer_ids) of a CSV of questions, with `split` only the rows whose places that file lists, in its order.

    Places count the CSV's lines from zero, which needs their order: the table of questions is small and read as one part.
    """
    rows = spark.read.schema("id bigint, query string, answer_ids string").option("header", True).option("multiLine", True).option("escape", '"').csv(questions).coalesce(1)
    rows = rows.withColumn("place", F.monotonically_increasing_id()).withColumn("answer_ids", F.from_json("answer_ids", "array<bigint>"))
    if split:
        listed = spark.read.text(split).coalesce(1).select(F.monotonically_increasing_id().alias("nth"), F.trim("value").cast("bigint").alias("place")).where("place is not null")
        rows = rows.join(F.broadcast(listed), "place").orderBy("nth").drop("nth")
    else:
        rows = rows.orderBy("place")
    return (rows if limit is None else rows.limit(limit)).select("id", "query", "answer_ids")


def csv_to_parquet(spark: SparkSession, source: str, target: str, schema: str) -> None:
    """Rewrites a CSV with a header as Parquet; the schema is given, so the file is read once."""
    spark.read.schema(schema).option("header", True).csv(source).write.mode("overwrite").parquet(target)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, encoding) of whole files: UTF-8 with or without a mark, else Latin-1, which has a character for each byte."""
    rows = spark.read.format("binaryFile").load(path)
    utf8 = F.try_validate_utf8(F.col("content").cast("string"))
    text = F.coalesce(F.regexp_replace(utf8, "^﻿", ""), F.decode("content", "ISO-8859-1"))
    return rows.select("path", text.alias("text"), F.when(utf8.isNotNull(), "utf-8").otherwise("latin1").alias("encoding"))


def first_text(*texts: Column) -> Column:
    """The first provider's text that is not blank."""
    return F.coalesce(*(F.nullif(F.trim(t), F.lit("")) for t in texts))


def needs_ocr(text: Column, least: int = 50) -> Column:
    return F.length(F.trim(F.coalesce(text, F.lit("")))) < least


def embed_pending(nodes: DataFrame, index_path: str, embed, key: str = "index") -> None:
    """Appends (key, embedding) for the nodes that are not in the index yet; `embed` makes a column from the nodes' own.

    Spark's commit makes each append whole or absent, so a run that breaks off is resumed by the next one.
    """
    try:
        done = nodes.sparkSession.read.parquet(index_path).select(key)
        nodes = nodes.join(done, key, "left_anti")
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
    nodes.select(key, embed.alias("embedding")).write.mode("append").parquet(index_path)


def unreadable(spark: SparkSession, folder: str) -> DataFrame:
    """(path, error) of the Parquet files below a folder that cannot be read to their end.

    Each file is opened by itself in a task and all its row groups are decoded, so neither a missing footer nor a damaged
    page goes unseen. A file must fit into a task's memory, as the chunks of an index do, and have under 2 GB.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(folder)

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                try:
                    reader = pq.ParquetFile(pa.BufferReader(content.as_buffer()))
                    for k in range(reader.num_row_groups):
                        reader.read_row_group(k)
                except (pa.ArrowException, OSError) as error:
                    found.append({"path": path, "error": str(error)})
            yield pa.RecordBatch.from_pylist(found, pa.schema([("path", pa.string()), ("error", pa.string())]))

    return files.select("path", "content").mapInArrow(opened, "path string, error string")


def quarantine(spark: SparkSession, folder: str) -> list[tuple[str, str]]:
    """Renames the unreadable files of a folder to `_<name>.bad.<time>.parquet`, which no reader of the folder takes up.

    Returns the new names with what was wrong. Good files stay as they are, and nothing is deleted.
    """
    limits = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1"}  # one file at a time in memory
    before = {k: spark.conf.get(k) for k in limits}
    try:
        for k, v in limits.items():
            spark.conf.set(k, v)
        found = unreadable(spark, folder).collect()  # the bad ones only
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    moved = []
    for path, error in found:
        old = spark._jvm.org.apache.hadoop.fs.Path(path)
        new = spark._jvm.org.apache.hadoop.fs.Path(old.getParent(), f"_{old.getName().removesuffix('.parquet')}.bad.{int(time.time())}.parquet")
        if not old.getFileSystem(spark._jsc.hadoopConfiguration()).rename(old, new):
            raise OSError(f"{path} cannot be renamed")
        moved.append((new.toString(), error))
    return moved


def compacted(spark: SparkSession, source: str, target: str, parts: int, key: str = "index") -> list[tuple[str, str]]:
    """Rewrites an index as `parts` files, one row for each key; files that cannot be read are moved away first and returned."""
    moved = quarantine(spark, source)
    spark.read.parquet(source).dropDuplicates([key]).repartition(parts, key).write.mode("overwrite").parquet(target)
    return moved


class Collections:
    """Vector collections as Parquet folders, one for each name; made when first written.

    A collection is a folder of versions. The current one is the last whose writing has ended, as Spark's own mark says, so
    a reader never sees half a deletion and a run that breaks off leaves the version before it. `vacuum` removes older ones.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self.held = spark, root.rstrip("/"), {}

    def path(self, name: str) -> str:
        if not name or len(name) > 256 or "/" in name:
            raise ValueError(f"no name of a collection: {name!r}")
        return f"{self.root}/{name}"

    def _fs(self, path: str):
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop, hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self, name: str) -> list[int]:
        """Numbers of the versions that are complete, in order."""
        folder, fs = self._fs(self.path(name))
        names = [x.getPath().getName() for x in fs.listStatus(folder)] if fs.exists(folder) else []
        found = [int(x[1:]) for x in names if x.startswith("v") and x[1:].isdigit()]
        return sorted(n for n in found if fs.exists(self._fs(f"{self.path(name)}/v{n}/_SUCCESS")[0]))

    def _current(self, name: str) -> str:
        return f"{self.path(name)}/v{(self.versions(name) or [0])[-1]}"

    def add(self, name: str, chunks: DataFrame) -> DataFrame:
        """Appends chunks (page_content and metadata columns) with an id from their content."""
        keyed = chunks.withColumn("chunk_key", F.sha2(F.concat_ws("\u0001", *(F.col(c).cast("string") for c in sorted(chunks.columns))), 256))
        keyed.write.mode("append").parquet(self._current(name))
        self.held.pop(name, None)
        return keyed

    def read(self, name: str) -> DataFrame:
        if name not in self.held:
            self.held[name] = self.spark.read.parquet(self._current(name))
        return self.held[name]

    def search(self, name: str, queries: DataFrame, k: int, where: Column | None = None, vector_col: str = "embedding", **names) -> DataFrame:
        """(query, item, score, rank): the `k` chunks of a collection nearest to each query vector; items are numbers in `id_col`."""
        from graphloom.operators.nearest import nearest

        rows = self.read(name)
        return nearest(rows if where is None else rows.where(where), queries, k, vector_col=vector_col, **names)

    def delete(self, name: str, condition: Column) -> int:
        """Writes a version without the rows for which the condition is true; returns their number."""
        rows = self.read(name)
        gone = rows.where(condition).count()
        if gone:
            number = self.versions(name)[-1] + 1
            rows.where(~F.coalesce(condition, F.lit(False))).write.mode("overwrite").parquet(f"{self.path(name)}/v{number}")
            self.held.pop(name, None)
        return gone

    def vacuum(self, name: str) -> int:
        """Removes all versions but the current one; returns their number. No reader may still use them."""
        old = self.versions(name)[:-1]
        for number in old:
            folder, fs = self._fs(f"{self.path(name)}/v{number}")
            fs.delete(folder, True)
        return len(old)
