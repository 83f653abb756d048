"""Named queries over the driver's tables and, where SQL can state them, the SQL for their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Register a function under its name, with the SQL that gives its rows."""

    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return put


def _load() -> None:
    from . import budget_queries, change_queries, entry_queries, file_queries, graph_queries, lifecycle_queries, log_queries, payload_queries, process_queries, replica_queries, report_queries, search_queries, source_queries, text_queries, type_queries  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return ORACLES
