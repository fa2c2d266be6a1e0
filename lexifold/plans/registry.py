"""All registered queries of the library but those of optional subpackages."""

from __future__ import annotations

from . import chunk_queries, evaluation_queries, retrieval_queries, session_queries, source_queries, speech_queries, text_queries

_MODULES = (text_queries, chunk_queries, retrieval_queries, evaluation_queries, session_queries, speech_queries, source_queries)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in _MODULES for k, s in m.SQL.items()}
