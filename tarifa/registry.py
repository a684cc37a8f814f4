"""Name of each query -> (Spark function, SQL for the oracle or None)."""

from __future__ import annotations

from tarifa.plans import model_queries, panel_queries, stream_queries, view_queries, week_queries

QUERIES = {}
ORACLE_SQL = {}
for _module in (panel_queries, model_queries, stream_queries, view_queries, week_queries):
    for _name, (_run, _sql) in _module.ALL.items():
        QUERIES[_name] = _run
        if _sql:
            ORACLE_SQL[_name] = _sql
