"""Registry of named queries: a Spark callable and, where SQL can say it, the oracle text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None, name: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name`` (its own name without underscores around it)."""
    def register(fn):
        key = name or fn.__name__.strip("_")
        if key in QUERIES:
            raise KeyError(f"query {key} is registered twice")
        QUERIES[key] = fn
        if oracle is not None:
            ORACLE[key] = oracle
        return fn

    return register
