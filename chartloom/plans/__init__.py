"""Registered queries: each plan module pairs Spark queries with their SQL check."""

from chartloom.plans import eyes, intake, lifecycle, report, stores, streams  # noqa: F401
from chartloom.plans.registry import CHECK_SQL, QUERIES

__all__ = ["CHECK_SQL", "QUERIES"]
