"""Named queries of the search engine and their DuckDB oracles."""

from __future__ import annotations

from tidewell.plans import preparation_queries, search_queries, source_queries

QUERIES = search_queries.QUERIES | preparation_queries.QUERIES | source_queries.QUERIES
ORACLE_SQL = search_queries.ORACLE_SQL | preparation_queries.ORACLE_SQL | source_queries.ORACLE_SQL
