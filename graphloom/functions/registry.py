"""Named operators with typed parameters, and their use from SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_MISSING = object()


class BadArgument(ValueError):
    """An argument that an operator cannot take."""


@dataclass(frozen=True)
class Parameter:
    name: str
    kind: type
    default: Any = _MISSING
    valid: Callable[[Any], bool] | None = None

    def take(self, value: Any) -> Any:
        if not isinstance(value, self.kind):
            try:
                value = self.kind(value)
            except (TypeError, ValueError) as error:
                raise BadArgument(f"{self.name} must be {self.kind.__name__}") from error
        if self.valid and not self.valid(value):
            raise BadArgument(f"{self.name} is not valid: {value!r}")
        return value


@dataclass(frozen=True)
class Operator:
    """A function from DataFrames and bound arguments to a DataFrame."""

    name: str
    run: Callable[..., DataFrame]
    parameters: tuple[Parameter, ...] = ()
    about: str = ""

    def bind(self, given: dict[str, Any]) -> dict[str, Any]:
        known = {p.name: p for p in self.parameters}
        if odd := sorted(set(given) - set(known)):
            raise BadArgument(f"{self.name} has no parameter {', '.join(odd)}")
        if lost := [n for n, p in known.items() if n not in given and p.default is _MISSING]:
            raise BadArgument(f"{self.name} needs {', '.join(lost)}")
        bound = {n: known[n].take(v) for n, v in given.items()}
        return {n: p.default for n, p in known.items() if n not in bound and p.default is not None} | bound

    def __call__(self, *frames: DataFrame, **given: Any) -> DataFrame:
        return self.run(*frames, **self.bind(given))


class Registry:
    """Operators by name; a kind of step (chunker, retriever, reranker) can be chosen by configuration."""

    def __init__(self) -> None:
        self.held: dict[str, Operator] = {}

    def add(self, operator: Operator) -> Operator:
        if operator.name in self.held:
            raise BadArgument(f"{operator.name} is registered already")
        self.held[operator.name] = operator
        return operator

    def get(self, name: str) -> Operator:
        if name not in self.held:
            raise BadArgument(f"no operator {name}; there are {', '.join(sorted(self.held))}")
        return self.held[name]

    def schema(self) -> list[dict[str, Any]]:
        return [{"name": o.name, "about": o.about, "parameters": [{"name": p.name, "type": p.kind.__name__, "required": p.default is _MISSING} for p in o.parameters]} for o in self.held.values()]


def chunkers() -> Registry:
    """The chunkers, each from (docs) with the columns' names as arguments."""
    from graphloom.operators import chunk

    names = (Parameter("id_col", str), Parameter("text_col", str))
    sizes = (Parameter("size", int, 1000, lambda n: n > 0), Parameter("overlap", int, 200, lambda n: n >= 0))
    out = Registry()
    out.add(Operator("standard", chunk.recursive, names + sizes, "cut at paragraphs, lines, words"))
    out.add(Operator("stride", chunk.strides, names + sizes, "pieces of fixed size"))
    out.add(Operator("contextual", chunk.contextual, names + sizes, "pieces behind their context"))
    out.add(Operator("markdown", chunk.markdown, names, "parts under headings"))
    out.add(Operator("parent_child", chunk.parents_and_children, names, "small pieces of large ones"))
    out.add(Operator("code", chunk.code, (*names, Parameter("language", str, "python", lambda x: x in chunk.LANGUAGES)), "cut at definitions"))
    return out


def rerankers() -> Registry:
    """The rerankers, each from (hits) to hits with `new_score` and `rank`."""
    from pyspark.sql import functions as F

    from graphloom.operators import fusion
    from graphloom.operators.retrieve import overlap

    def by_overlap(hits: DataFrame, query: str, text: str, group: str, order: str, k: int) -> DataFrame:
        return fusion.reranked(hits, overlap(F.col(query), F.col(text)), group, text, order, k)

    def by_length(hits: DataFrame, text: str, group: str, order: str, k: int) -> DataFrame:
        return fusion.reranked(hits, -F.length(text), group, text, order, k)

    names = (Parameter("text", str), Parameter("group", str), Parameter("order", str), Parameter("k", int, 5, lambda n: n > 0))
    out = Registry()
    out.add(Operator("overlap", by_overlap, (Parameter("query", str), *names), "by the share of the query's words"))
    out.add(Operator("shortest", by_length, names, "shorter texts first"))
    return out


def retrievers() -> Registry:
    """The retrievers, each from (documents, queries) to (query, doc or item, score, rank)."""
    from graphloom.operators import nearest, search

    def sparse(docs: DataFrame, queries: DataFrame, doc_id: str, doc_text: str, query_id: str, query_text: str, k: int, **more: Any) -> DataFrame:
        return search.bm25_top(docs, queries, doc_id, doc_text, query_id, query_text, k, **more)

    texts = (Parameter("doc_id", str), Parameter("doc_text", str), Parameter("query_id", str), Parameter("query_text", str), Parameter("k", int, 10, lambda n: n > 0))
    out = Registry()
    out.add(Operator("bm25", sparse, texts, "ranked by words"))
    out.add(Operator("okapi", lambda *frames, **given: sparse(*frames, k1=1.5, okapi=True, **given), texts, "ranked by words, common ones for less"))
    out.add(Operator("vectors", nearest.nearest, (Parameter("k", int, 10, lambda n: n > 0), Parameter("id_col", str, "vec_id"), Parameter("vector_col", str, "embedding")), "ranked by cosine"))
    return out


@dataclass(frozen=True)
class Task:
    """A step by name, from a context to what it adds to it; what it needs must be there."""

    name: str
    step: Callable[[dict[str, Any]], dict[str, Any]]
    needs: tuple[str, ...] = ()

    def run(self, context: dict[str, Any]) -> dict[str, Any]:
        if lost := [n for n in self.needs if n not in context]:
            raise BadArgument(f"{self.name} needs {', '.join(lost)}")
        return context | self.step(context)


def run_tasks(tasks: list[Task], context: dict[str, Any]) -> dict[str, Any]:
    """The context after all tasks, one after the other."""
    for task in tasks:
        context = task.run(context)
    return context


def register_functions(spark: SparkSession) -> None:
    """SQL functions, the first two with the rows of `chunk.recursive`:

    chunk_table(table(select id, text ...), size, overlap) gives (id, chunk_id, chunk), ids as text, from Arrow batches; it
    is the one for whole tables. recursive_chunks(text, size, overlap) gives (chunk_id, chunk) of one text, and after
    `lateral` too, where Spark takes no table function of Arrow batches. count_words(text) is SQL.
    """
    from pyspark.sql import functions as F

    from graphloom.operators.chunk import SEPARATORS, _split

    @F.arrow_udtf(returnType="id string, chunk_id long, chunk string")
    class ChunkTable:
        def eval(self, rows: pa.RecordBatch, size: pa.Array, overlap: pa.Array) -> Iterator[pa.Table]:
            if not rows.num_rows:
                return
            most, carried = size[0].as_py(), overlap[0].as_py()
            names = rows.column(0).cast(pa.string())
            for k, text in enumerate(rows.column(1).to_pylist()):  # a text's pieces leave before the next one is cut
                pieces = list(_split(text or "", SEPARATORS, most, carried))
                yield pa.table({"id": pa.array([names[k].as_py()] * len(pieces), pa.string()), "chunk_id": pa.array(range(len(pieces)), pa.int64()), "chunk": pa.array(pieces, pa.string())})

    @F.udtf(returnType="chunk_id int, chunk string")
    class RecursiveChunks:
        def eval(self, text: str, size: int, overlap: int):
            yield from enumerate(_split(text or "", SEPARATORS, size, overlap))

    spark.udtf.register("chunk_table", ChunkTable)
    spark.udtf.register("recursive_chunks", RecursiveChunks)
    spark.sql("create or replace temporary function count_words(t string) returns int return size(filter(split(t, '\\\\s+'), w -> w <> ''))")
