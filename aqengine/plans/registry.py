"""All queries of the engine by name, and the SQL that gives the same rows."""

from __future__ import annotations

from . import air_queries, ml_queries, serving_queries, sink_queries, stream_queries

_PARTS = (air_queries, serving_queries, ml_queries, stream_queries, sink_queries)
QUERIES: dict = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLES: dict[str, str] = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
