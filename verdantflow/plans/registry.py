"""Queries over the given tables by name, with SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from verdantflow.plans import more_queries, panel_queries, record_queries, score_queries, text_queries

FLAGSHIP = "greenness_by_sector"
_MODULES = (score_queries, panel_queries, text_queries, more_queries, record_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: s for m in _MODULES for name, s in m.ORACLE_SQL.items()}
