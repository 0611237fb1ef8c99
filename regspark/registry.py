"""Queries of the library's own operators, and their SQL."""

from regspark.plans import chunks, patterns, records, search, store, streams  # noqa: F401  register their queries
from regspark.plans.queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
