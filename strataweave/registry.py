"""Queries of the library's own operators, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from .plans import fixtures

#: Modules that register queries.
MODULES: tuple[str, ...] = ("q_flags", "q_graph", "q_feedback", "q_facts", "q_audit", "q_rules", "q_documents", "q_streams", "q_store", "q_linking", "q_messages", "q_modeling", "q_reasoning")


def _load() -> None:
    for name in MODULES:
        import_module(f"strataweave.plans.{name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(fixtures.QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(fixtures.ORACLE)
