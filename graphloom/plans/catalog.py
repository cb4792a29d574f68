"""All queries of the library and the SQL they agree with."""

from __future__ import annotations

from graphloom.plans import base, evaluation, functions, graph, lifecycle, retrieval, text, trajectories, vectors  # noqa: F401


def flagship(spark, sf_dir):
    return base.QUERIES["bm25_topk"](spark, sf_dir)


def queries() -> dict:
    return dict(base.QUERIES)


def oracle_sql() -> dict:
    return dict(base.SQL)
