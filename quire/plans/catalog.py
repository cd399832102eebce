"""All registered queries and their oracle SQL (importing the modules registers them)."""

from __future__ import annotations

from quire.plans import oracle, oracle_links, oracle_outline, oracle_io, oracle_results, oracle_side, oracle_text  # noqa: F401
from quire.plans import (  # noqa: F401
    queries, queries_io, queries_links, queries_outline, queries_results, queries_side, queries_text,
)
from quire.plans.oracle import SQL
from quire.plans.queries import QUERIES

__all__ = ["QUERIES", "SQL"]
