"""All queries outside the training-data operators, with the SQL that must give the same rows."""

from __future__ import annotations

from tidemark.plans import classes, further_queries, ingest_queries, operator_queries  # noqa: F401  registers them
from tidemark.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
