"""The registered queries for the document operators, and the SQL that each must match."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import document_queries, layout_queries, office_queries, page_queries, table_queries, text_queries

_ALL = {**text_queries.QUERIES, **table_queries.QUERIES, **layout_queries.QUERIES, **document_queries.QUERIES, **page_queries.QUERIES, **office_queries.QUERIES}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for k, (f, _) in _ALL.items()}
SQL: dict[str, str] = {k: sql for k, (_, sql) in _ALL.items() if sql}
