"""Registered queries and their SQL oracles, gathered from the modules of this package."""

from __future__ import annotations

from trialforge.plans import checks, ingests, layout, progress, reports, scores, sketched, statistics, texts, traces  # noqa: F401  (they register their queries)
from trialforge.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
