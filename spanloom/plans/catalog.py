"""All queries of the engine, by name, with the SQL that says the same."""

from __future__ import annotations

from . import artifact_queries, enrich_queries, graph_queries, ingest_queries, source_queries, text_queries

FLAGSHIP = "flow_trace_set"
_MODULES = (graph_queries, text_queries, source_queries, artifact_queries, enrich_queries, ingest_queries)
QUERIES = {name: run for m in _MODULES for name, run in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
