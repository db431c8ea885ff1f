"""Queries of the reference's operators, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Registers a function of (spark, sf_dir)."""

    def put(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return put


def load() -> None:
    """Imports the modules that register queries."""
    from . import silver_queries, feature_queries, score_queries  # noqa: F401, I001
    from . import audit_queries, evaluation_queries, model_queries, serving_queries, stream_queries, survival_queries  # noqa: F401
