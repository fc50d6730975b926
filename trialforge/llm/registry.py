"""Queries opN_* over the whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from trialforge.llm import queries

QUERIES = {name: f for name, f in vars(queries).items() if name.startswith("op") and callable(f)}
ORACLE_SQL = dict(queries.ORACLE_SQL)
