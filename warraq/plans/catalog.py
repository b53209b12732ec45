"""All registered core queries: name -> (query, DuckDB oracle or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import cleaning, corpus, evaluation, hot, profile, relational, vocabulary

Query = Callable[[SparkSession, str], DataFrame]

_MODULES = (profile, cleaning, vocabulary, relational, evaluation, corpus, hot)


def queries() -> dict[str, Query]:
    """Queries of all plan modules."""
    return {name: q for m in _MODULES for name, q in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    """Oracle SQL of all plan modules."""
    return {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
