"""All queries of the library over the given tables, with their SQL for another engine."""

from __future__ import annotations

from lodestone.jobs import base, planted, planted_pages, specifications  # noqa: F401  each registers its queries
from lodestone.jobs.catalog import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
