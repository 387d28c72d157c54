"""All registered queries over the given tables."""

from newsweave.catalog import maintain, pages, relational, streams, text, trends, urls  # noqa: F401
from newsweave.catalog.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
