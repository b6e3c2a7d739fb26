"""Query id -> (callable, oracle SQL or None), gathered from the plan modules."""

from __future__ import annotations

from . import (chunk_queries, code_queries, dictionary_queries, graph_queries,
               retrieve_queries, runtime_queries, warehouse_queries)

_MODULES = [warehouse_queries, graph_queries, code_queries, chunk_queries, retrieve_queries,
            dictionary_queries, runtime_queries]

QUERIES = {}
ORACLE_SQL = {}
for _m in _MODULES:
    for _name, (_fn, _sql) in _m.QUERIES.items():
        if _name in QUERIES:
            raise ValueError(f"duplicate query id {_name}")
        QUERIES[_name] = _fn
        if _sql is not None:
            ORACLE_SQL[_name] = _sql
