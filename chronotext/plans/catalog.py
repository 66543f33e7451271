"""Registry of the library's queries and of their DuckDB oracles."""

from . import edit_queries, format_queries, interval_queries, line_queries, log_queries, matching_queries, scalar_queries, store_queries

_MODULES = (interval_queries, log_queries, edit_queries, format_queries, scalar_queries, line_queries, matching_queries, store_queries)

QUERIES: dict = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLE: dict = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
