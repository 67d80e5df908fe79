"""All registered queries of the engine's own operators."""

from textloom.plans import feature_queries, queries, table_queries
from textloom.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "feature_queries", "queries", "table_queries"]
