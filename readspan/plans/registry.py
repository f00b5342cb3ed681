"""Every query of the engine by name, and the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from readspan.plans import edit_queries, figure_queries, session_queries, source_queries, state_queries, table_queries

_MODULES = (session_queries, table_queries, source_queries, edit_queries, figure_queries, state_queries)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLES: dict[str, str] = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
