"""Collections of chunks as a source for `spark.read.format("collection")`, with versions and filters that reach the files.

    register_source(spark)
    spark.read.format("collection").option("version", 3).load("hdfs://host/collections/papers").where("lang = 'en'")

The newest complete version is chosen when an action is planned, and its files are listed then; a deletion writes another
version, so a reader that has begun keeps the rows it began with until `Collections.vacuum` removes the old folder.
`snapshot` chooses the version at once, for several actions on the same rows.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql.types import StructType

#: Bytes that a task reads: row groups of one file go together up to this; rows of a batch that goes to Spark.
TASK_BYTES, BATCH_ROWS = 128 << 20, 4096


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    # Spark's own form of a local address has one slash, Arrow's has three.
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    return pafs.FileSystem.from_uri(path)


def complete_versions(path: str) -> list[int]:
    """Numbers of the versions of a collection whose writing has ended, in order."""
    fs, root = _opened(path)
    folders = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
    found = [int(x.base_name[1:]) for x in folders if x.type == pafs.FileType.Directory and x.base_name.startswith("v") and x.base_name[1:].isdigit()]
    marks = fs.get_file_info([f"{root}/v{n}/_SUCCESS" for n in found]) if found else []
    return sorted(n for n, mark in zip(found, marks, strict=True) if mark.type == pafs.FileType.File)


@dataclass
class RowGroups(D.InputPartition):
    file: str
    groups: list[int]


def _expression(f: D.Filter) -> ds.Expression | None:
    """What Arrow can test of a filter; none for nested columns and other kinds."""
    if isinstance(f, D.Not):
        inner = _expression(f.child)
        return None if inner is None else ~inner
    if len(getattr(f, "attribute", ())) != 1:
        return None
    field = ds.field(f.attribute[0])
    compared = {D.EqualTo: operator.eq, D.GreaterThan: operator.gt, D.GreaterThanOrEqual: operator.ge, D.LessThan: operator.lt, D.LessThanOrEqual: operator.le}
    if type(f) in compared and isinstance(f.value, (bool, int, float, str)) and f.value == f.value:
        return compared[type(f)](field, f.value)
    if isinstance(f, D.In) and all(isinstance(x, (bool, int, str)) for x in f.value):
        return field.isin(list(f.value))
    if isinstance(f, D.IsNull):
        return field.is_null()
    if isinstance(f, D.IsNotNull):
        return field.is_valid()
    return None


class CollectionReader(D.DataSourceReader):
    def __init__(self, folder: str | None, schema: StructType) -> None:
        self.folder, self.schema, self.wanted = folder, schema, []

    def pushFilters(self, filters: list[D.Filter]) -> Iterable[D.Filter]:  # noqa: N802
        for f in filters:
            if _expression(f) is not None:
                self.wanted.append(f)
            # Spark tests each row again, so that its own rules for NaN and types of numbers decide
            yield f

    def _expr(self) -> ds.Expression | None:
        return functools.reduce(operator.and_, map(_expression, self.wanted)) if self.wanted else None

    def _fragment(self, file: str, groups: list[int] | None = None) -> ds.ParquetFileFragment:
        fs, root = _opened(file)
        return ds.ParquetFileFormat().make_fragment(root, fs, row_groups=groups)

    def partitions(self) -> list[RowGroups]:
        if self.folder is None:
            return []
        fs, root = _opened(self.folder)
        scheme = self.folder.removesuffix(root) if self.folder.endswith(root) else "file://"
        out, wanted = [], self._expr()
        for info in fs.get_file_info(pafs.FileSelector(root, recursive=True)):
            if not info.is_file or not info.base_name.endswith(".parquet") or info.base_name.startswith(("_", ".")):
                continue
            file, held, size = scheme + info.path, [], 0
            if info.size <= TASK_BYTES:
                out.append(RowGroups(file, []))  # its footer is read by the task, which passes over row groups by the filter
                continue
            for part in self._fragment(file).split_by_row_group(wanted):
                group = part.row_groups[0]
                if held and size + group.total_byte_size > TASK_BYTES:
                    out.append(RowGroups(file, held))
                    held, size = [], 0
                held.append(group.id)
                size += group.total_byte_size
            if held:
                out.append(RowGroups(file, held))
        return out

    def read(self, partition: RowGroups) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(self.schema)
        fragment = self._fragment(partition.file, partition.groups or None)
        for batch in fragment.to_batches(columns=schema.names, filter=self._expr(), schema=schema, batch_size=BATCH_ROWS):
            if batch.num_rows:
                yield batch


class CollectionSource(D.DataSource):
    """Options: `path`, or what `load` is given, and `version`, else the newest complete one. A collection without any has
    no rows, and then needs a schema; a version that is not there is an error."""

    @classmethod
    def name(cls) -> str:
        return "collection"

    def _folder(self) -> str | None:
        path = self.options["path"].rstrip("/")
        known, asked = complete_versions(path), self.options.get("version")
        if asked is not None and int(asked) not in known:
            raise ValueError(f"{path} has no version {asked}; there are {known}")
        number = int(asked) if asked is not None else known[-1] if known else None
        return None if number is None else f"{path}/v{number}"

    def schema(self) -> StructType:
        from pyspark.sql.pandas.types import from_arrow_schema

        folder = self._folder()
        if folder is None:
            raise ValueError("an empty collection needs a schema")
        fs, root = _opened(folder)
        first = next(x.path for x in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if x.base_name.endswith(".parquet"))
        with fs.open_input_file(first) as file:
            found = pq.read_schema(file)
        # times of Spark's files are moments; Arrow marks them so
        return from_arrow_schema(found)

    def reader(self, schema: StructType) -> CollectionReader:
        return CollectionReader(self._folder(), schema)


def register_source(spark: SparkSession) -> None:
    """Makes `spark.read.format("collection")` known, with filters handed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CollectionSource)


def snapshot(spark: SparkSession, path: str) -> DataFrame:
    """A collection's rows as its newest version has them now, whatever is deleted afterwards."""
    register_source(spark)
    found = complete_versions(path)
    if not found:
        raise ValueError(f"no version of {path} is complete")
    return spark.read.format("collection").option("version", found[-1]).load(path)
