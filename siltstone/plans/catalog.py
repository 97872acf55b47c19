"""All queries of the library and the SQL that they are compared with."""

from __future__ import annotations

from . import archive_queries, graph_queries, text_queries, vector_queries, work_queries

FLAGSHIP = "exact_top10"
_PARTS = (vector_queries.R, text_queries.R, graph_queries.R, work_queries.R, archive_queries.R)
QUERIES = {name: f for part in _PARTS for name, f in part.queries.items()}
ORACLE = {name: sql for part in _PARTS for name, sql in part.oracle.items()}
