"""Registered queries over the driver's tables, and their SQL."""

from . import blank_queries, bundle_queries, form_queries, page_queries, queries, record_queries, recovery_queries, run_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
