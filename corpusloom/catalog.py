"""Registry of the library's own queries and their SQL."""

from __future__ import annotations

from corpusloom.plans.queries import queries
from corpusloom.plans.sql import oracle_sql

__all__ = ["oracle_sql", "queries"]
