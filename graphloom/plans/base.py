"""Registration of queries with their SQL, and the tables that they read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, sf_dir) and the DuckDB SQL that gives the same rows."""

    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def placed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table with `place`, a number that orders its rows as they lie: by the names of its files, and within a file."""
    rows = table(spark, sf_dir, name)
    row = F.col("_metadata.row_index")
    if len(rows.inputFiles()) < 2:
        return rows.select("*", row.alias("place"))
    paths = sorted(r[0] for r in rows.select("_metadata.file_path").distinct().collect())
    files = spark.createDataFrame(list(enumerate(paths)), "_file long, _path string")
    located = rows.select("*", row.alias("_row"), F.col("_metadata.file_path").alias("_path"))
    return located.join(F.broadcast(files), "_path").select(*rows.columns, F.expr("shiftleft(_file, 40) + _row").alias("place"))
