"""Streams: file ingest into merged tables, resumable embedding, running metrics, request windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


class MergedStream:
    """A table merged from files of arrivals, kept as a state that each batch reads and renews for the keys it touches.

    `partial` makes a state of arrivals and `combine` one of several, grouped by `key` and whatever else, such as
    `merge.partial_state` and `merge.combined` do. Below `root` the state of each of `buckets` ranges of keys lies in the
    folder of the batch that last wrote it. A batch reads the last states of its own buckets and never earlier arrivals, so
    what it costs does not grow with their number. A batch that is run again starts from the states before it, which
    stay until a later batch supersedes them, so no arrival is counted twice.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str, partial: Callable[[DataFrame], DataFrame], combine: Callable[[DataFrame], DataFrame], key: str = "id", buckets: int = 64) -> None:
        self.spark, self.root, self.schema, self.partial, self.combine, self.key, self.buckets = spark, root.rstrip("/"), schema, partial, combine, key, buckets
        self.kept = partial(spark.createDataFrame([], schema)).schema

    def start(self, source: str, files_a_batch: int | None = None) -> StreamingQuery:
        """Reads the files of `source` that are new since the last run."""
        reader = self.spark.readStream.schema(self.schema)
        reader = reader.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else reader
        return reader.parquet(source).writeStream.foreachBatch(self.put).option("checkpointLocation", f"{self.root}/checkpoint").trigger(availableNow=True).start()

    def read(self) -> DataFrame:
        """The state after the last whole batch."""
        return self._states([versions[-1] for versions in self._versions().values()])

    def put(self, batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        arrived = f"{self.root}/arrived/batch={number}"
        self._write(self.partial(batch), arrived)
        touched = {bucket: [n for n in self._versions().get(bucket, []) if n[0] < number] for bucket in self._buckets_of(arrived)}
        old = self._states([versions[-1] for versions in touched.values() if versions])
        fresh = self._load([f"{arrived}/_bucket={bucket}" for bucket in touched])
        self._write(self.combine(old.unionByName(fresh)), f"{self.root}/state/batch={number}")
        self._remove(arrived)
        for versions in touched.values():
            for _, path in versions[:-1]:
                self._remove(path)

    def _write(self, state: DataFrame, path: str) -> None:
        dealt = state.select(*self.kept.names, F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int").alias("_bucket"))
        dealt.hint("rebalance", "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(path)

    def _load(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(self.kept).parquet(*paths).select(self.kept.names) if paths else self.spark.createDataFrame([], self.kept)

    def _states(self, versions: list[tuple[int, str]]) -> DataFrame:
        return self._load([path for _, path in versions])

    def _fs(self, path: str):
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop, hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _numbers(self, path: str, name: str) -> list[int]:
        folder, fs = self._fs(path)
        names = [x.getPath().getName() for x in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(x[len(name) + 1 :]) for x in names if x.startswith(f"{name}="))

    def _buckets_of(self, path: str) -> list[int]:
        return self._numbers(path, "_bucket")

    def _versions(self) -> dict[int, list[tuple[int, str]]]:
        """Numbers of whole batches and their folders, for each bucket, in order; two or so for each."""
        found: dict[int, list[tuple[int, str]]] = {}
        for number in self._numbers(f"{self.root}/state", "batch"):
            folder = f"{self.root}/state/batch={number}"
            marker, fs = self._fs(f"{folder}/_SUCCESS")
            buckets = self._buckets_of(folder) if fs.exists(marker) else []
            for bucket in buckets:
                found.setdefault(bucket, []).append((number, f"{folder}/_bucket={bucket}"))
        return found

    def _remove(self, path: str) -> None:
        folder, fs = self._fs(path)
        fs.delete(folder, True)
        above = folder.getParent()
        if above.getName().startswith("batch=") and not self._buckets_of(above.toString()):
            fs.delete(above, True)


def embed(spark: SparkSession, source: str, schema: str, index: str, column, checkpoint: str, key: str = "index") -> StreamingQuery:
    """Embeds the nodes of new files that the index does not hold."""
    from graphloom.sources.files import embed_pending

    def put(batch: DataFrame, _: int) -> None:
        embed_pending(batch.dropDuplicates([key]), index, column, key)

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_metrics(events: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, total, most) of all events so far; the same on a table and on a stream in complete mode."""
    return events.groupBy(key).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total"), F.round(F.max(value), 4).alias("most"))


def request_windows(events: DataFrame, key: str, ts: str, length: str = "60 seconds", slide: str = "10 seconds", late: str = "10 minutes") -> DataFrame:
    """(key, start, n): requests in sliding windows of event time; the state of windows older than `late` goes."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    return rows.groupBy(key, F.window(ts, length, slide).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "n")


def once_each(events: DataFrame, keys: list[str], ts: str, late: str = "10 minutes") -> DataFrame:
    """Events without repeats of their keys within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def sessions(events: DataFrame, key: str, ts: str, gap: str = "30 minutes") -> DataFrame:
    """(key, start, end, n) of runs of events with gaps below `gap`."""
    rows = events.withWatermark(ts, gap) if events.isStreaming else events
    return rows.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
