"""Where modules of queries keep them by name, beside the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable


def registry() -> tuple[Callable, dict, dict]:
    """(decorator that takes the SQL, queries by name, SQL by name)."""
    queries, oracles = {}, {}

    def query(sql: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if sql is not None:
                oracles[f.__name__] = sql
            return f

        return add

    return query, queries, oracles
