"""Merging of extracted records into a graph, and deletion by document.

There is no table format with updates here, so each operator returns the new state of a table, which a caller writes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merged_lists(docs: str, order: str) -> Column:
    """Documents in order of arrival, each once; those without a place come last."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).isNull().alias("open"), F.col(order).alias("o"), F.col(docs).alias("d"))))
    return F.array_distinct(F.filter(F.transform(pairs, lambda x: x["d"]), lambda x: x.isNotNull()))


def partial_state(rows: DataFrame, keys: list[str], first: list[str] = [], last: list[str] = [], order: str = "seq", docs: str = "source_document", tie: str | None = None, counted: str | None = None) -> DataFrame:  # noqa: B006
    """What arrivals amount to, one row for each key and document, in a form that later arrivals can be merged into.

    Columns in `first` hold the earliest value that is not null, those in `last` the latest, each with its place in the
    order; `at` is the first place and `n` the number of arrivals, with `counted` only of those where that column holds. A value
    without a place is passed over. Of equal places the arrival with the smallest `tie`, a number, counts in both; without one
    the smallest, or largest, value.
    A key with very many arrivals is summed up in the tasks that read them, and by document after that.
    """

    def placed(c: str, sign: int) -> Column:
        ties = [] if tie is None else [(sign * F.col(tie)).alias("tie")]
        return F.when(F.col(c).isNotNull() & F.col(order).isNotNull(), F.struct(F.col(order).alias("at"), *ties, F.col(c).alias("value")))

    n = F.count("*") if counted is None else F.count_if(counted)
    return rows.groupBy(*keys, docs).agg(*(F.min(placed(c, 1)).alias(c) for c in first), *(F.max(placed(c, -1)).alias(c) for c in last), F.min(order).alias("at"), n.alias("n"))


def combined(states: DataFrame, keys: list[str], first: list[str] = [], last: list[str] = [], docs: str = "source_document") -> DataFrame:  # noqa: B006
    """One state of several, whatever their order."""
    return states.groupBy(*keys, docs).agg(*(F.min(c).alias(c) for c in first), *(F.max(c).alias(c) for c in last), F.min("at").alias("at"), F.sum("n").alias("n"))


def from_state(state: DataFrame, keys: list[str], first: list[str] = [], last: list[str] = [], docs: str = "source_document") -> DataFrame:  # noqa: B006
    """(keys, first, last, source_documents, n) of a state; documents by their first arrival."""
    values = [*(F.min(c)["value"].alias(c) for c in first), *(F.max(c)["value"].alias(c) for c in last)]
    return state.groupBy(*keys).agg(*values, merged_lists(docs, "at").alias("source_documents"), F.sum("n").alias("n"))


def merge_entities(rows: DataFrame, order: str = "seq", tie: str | None = None) -> DataFrame:
    """(id, type, description, source_documents, n) of arrivals (id, type, description, source_document, seq).

    Type and description come from the first arrival that has one; an empty text counts as one, null does not. Where
    arrivals have an `embedding`, the last one that is not null is kept, as it belongs to the newest text.
    Arrivals of the same place in the order count by `tie`, as `partial_state` says.
    """
    last = ["embedding"] if "embedding" in rows.columns else []
    return from_state(partial_state(rows, ["id"], ["type", "description"], last, order, tie=tie), ["id"], ["type", "description"], last)


def merge_relations(rows: DataFrame, entities: DataFrame, order: str = "seq") -> tuple[DataFrame, DataFrame]:
    """Relations with both ends among `entities` (id), and the counts (seen, stored) of distinct ones."""
    first = F.min_by("description", F.when(F.col("description").isNotNull(), F.col(order)))
    all_ = rows.groupBy("source", "type", "target").agg(first.alias("description"), merged_lists("source_document", order).alias("source_documents"))
    ids = entities.select("id").distinct()
    kept = all_.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi").select("source", "type", "target", "description", "source_documents")
    counts = all_.agg(F.count("*").alias("seen")).crossJoin(kept.agg(F.count("*").alias("stored")))
    return kept, counts


def merge_claims(rows: DataFrame, entities: DataFrame, order: str = "seq") -> tuple[DataFrame, DataFrame]:
    """(claims by id, links (entity, claim, kind) to entities that exist) of (subject_id, object_id, description, source_document, seq)."""
    from graphloom.functions.text import claim_id

    keyed = rows.withColumn("id", claim_id(F.col("subject_id"), F.col("description")))
    claims = keyed.groupBy("id").agg(*(F.min_by(c, order).alias(c) for c in ("subject_id", "object_id", "description")), merged_lists("source_document", order).alias("source_documents"))
    ends = claims.select("id", F.explode(F.array(F.struct(F.lit("HAS_CLAIM").alias("kind"), F.col("subject_id").alias("entity")), F.struct(F.lit("REFERENCES").alias("kind"), F.col("object_id").alias("entity")))).alias("e"))
    links = ends.select(F.col("e.entity").alias("entity"), F.col("id").alias("claim"), "e.kind").join(entities.select(F.col("id").alias("entity")).distinct(), "entity", "left_semi")
    return claims, links


def new_only(found: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `found` whose keys, trimmed and in upper case, are not in `known`; the first of repeated ones by all columns."""
    folded = {f"_{k}": F.upper(F.trim(F.col(k))) for k in keys}
    once = Window.partitionBy(*folded).orderBy(*found.columns)
    fresh = found.withColumns(folded).withColumn("_n", F.row_number().over(once)).where("_n = 1").drop("_n")
    return fresh.join(known.select(*(v.alias(k) for k, v in folded.items())).distinct(), list(folded), "left_anti").select(found.columns)


def glean(first: DataFrame, rounds: Callable[[int], DataFrame | None], keys: list[str], most: int = 2) -> DataFrame:
    """`first` with what up to `most` further rounds find anew; it stops when a round finds nothing."""
    known = first
    for k in range(most):
        found = rounds(k)
        if found is None:
            break
        fresh = new_only(found, known, keys)
        if fresh.isEmpty():
            break
        known = known.unionByName(fresh)
    return known


def without_document(rows: DataFrame, document: str, docs: str = "source_documents") -> DataFrame:
    """Rows less the document in their lists; rows whose list becomes empty go, rows without a list stay."""
    kept = F.array_remove(docs, document)
    return rows.where(F.col(docs).isNull() | (F.size(kept) > 0)).withColumn(docs, kept)


def delete_document(entities: DataFrame, relations: DataFrame, claims: DataFrame, document: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without a document; relations and claims of entities that go, go with them."""
    left = without_document(entities, document)
    ids = left.select("id")
    joined = without_document(relations, document).join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return left, joined.select(relations.columns), without_document(claims, document)


def latest_status(changes: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(key, status, entity_count): the last status of each document, and its last count over zero."""
    place = F.struct(*order)
    count = F.max_by("entity_count", F.when(F.col("entity_count") > 0, place))
    return changes.groupBy(key).agg(F.max_by("status", place).alias("status"), F.coalesce(count, F.lit(0)).alias("entity_count"))


def pending(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not done yet."""
    return rows.join(done.select(key).distinct(), key, "left_anti")
