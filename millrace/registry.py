"""All core queries, collected from the operator modules."""

from __future__ import annotations

from millrace.operators import chunking, diagnosis, facts, graph, lines, metadata, mutations, nested, paths, symbols, vectors, web
from millrace.plans import pipelines, warehouse
from millrace.streaming import events

_MODULES = [nested, metadata, vectors, paths, facts, chunking, lines, web, diagnosis, graph, symbols, mutations, pipelines, warehouse, events]
FLAGSHIP = pipelines.QUERIES["plan_analyze"]


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in _MODULES for k, v in getattr(m, "ORACLE_SQL", {}).items()}
