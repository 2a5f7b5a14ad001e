"""Queries over the given tables and the SQL that must give the same rows."""

from __future__ import annotations

from . import report_queries, scoring_queries, stream_queries, streaming_runs

_MODULES = (scoring_queries, stream_queries, report_queries, streaming_runs)

QUERIES: dict = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL: dict[str, str] = {k: f for m in _MODULES for k, f in m.SQL.items()}
