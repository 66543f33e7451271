"""A module's table of queries and oracles, and the decorator that fills it."""

from __future__ import annotations


def registry() -> tuple[dict, dict, object]:
    queries: dict = {}
    oracle: dict = {}

    def query(sql: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if sql:
                oracle[f.__name__] = sql
            return f

        return add

    return queries, oracle, query
