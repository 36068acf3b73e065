"""Registration of queries with their SQL."""

from __future__ import annotations

from noticejobs.sources.adapters import sql

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(body: str | None = None, *tables: str):
    """Register a function (spark, sf_dir) under its name; ``body`` is the same result in SQL over derived tables."""

    def add(f):
        QUERIES[f.__name__] = f
        if body is not None:
            SQL[f.__name__] = sql(body, *tables) if tables else body.strip()
        return f

    return add
