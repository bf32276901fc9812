"""All queries of the lineage engine by name, each with its SQL twin."""

from __future__ import annotations

from strandgraph.plans import queries_files, queries_flow, queries_graph, queries_state, queries_work

_MODULES = (queries_graph, queries_flow, queries_state, queries_work, queries_files)


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in _MODULES for k, s in m.ORACLE_SQL.items()}
