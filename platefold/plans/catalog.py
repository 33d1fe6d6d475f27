"""Every query of the library with its SQL: what the driver runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import document_queries, item_queries, optimizer_queries, page_queries, source_queries, text_queries

PARTS = (optimizer_queries, item_queries, text_queries, source_queries, page_queries, document_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for p in PARTS for n, f in p.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {n: q for p in PARTS for n, q in p.SQL.items()}
