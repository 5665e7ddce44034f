"""Every registered query over the test tables, with the SQL that must give the same rows."""

from __future__ import annotations

from noticeworks.plans import calls, cards, interfaces, notices, orders, reports, sources  # noqa: F401  they register their queries
from noticeworks.plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
