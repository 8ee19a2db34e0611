"""All queries of the engine and their SQL."""

from __future__ import annotations

from lodestone.plans import grids, markup, measure, more, parsing, permits, runs  # noqa: F401  they register their queries
from lodestone.plans.base import ORACLE_SQL, QUERIES  # noqa: F401

FLAGSHIP = "reconcile_office_month"
