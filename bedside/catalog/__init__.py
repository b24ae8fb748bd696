"""Queries over the given tables with the SQL that checks them."""

from bedside.catalog import clinical_queries, event_queries, model_queries  # noqa: F401  (they register their queries)
from bedside.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
