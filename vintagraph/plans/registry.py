"""How query modules register their queries and SQL."""

from __future__ import annotations


class Registry:
    """Collects queries (name of the function -> function) and their SQL."""

    def __init__(self):
        self.queries: dict = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None):
        def add(f):
            self.queries[f.__name__] = f
            if sql is not None:
                self.sql[f.__name__] = sql
            return f

        return add
