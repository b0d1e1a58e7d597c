"""Every query of the engine's own operators, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corvana.plans import audit_queries, corpus_queries, derived_queries, more_queries, rank_queries, report_queries, state_queries, text_queries

_PARTS = (text_queries, rank_queries, audit_queries, more_queries, corpus_queries, report_queries, derived_queries, state_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLE: dict[str, str] = {name: sql for part in _PARTS for name, sql in part.ORACLE.items()}
