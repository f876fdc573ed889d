"""Registered queries of the engine, with their DuckDB counterparts."""

from __future__ import annotations

from quire.operators import cases, columns, decision_cases, dictionary, events, evidence, hierarchy, matching, nodes, package_cases, pages, proposals, published, relations, screens, search, summaries
from quire.streaming import states

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

for _module in (search, screens, cases, decision_cases, relations, matching, hierarchy, events, evidence, pages, proposals, package_cases, published, dictionary, nodes, columns, summaries, states):
    QUERIES.update(_module.QUERIES)
    ORACLE_SQL.update(getattr(_module, "ORACLE_SQL", {}))
