"""All registered queries of the engine proper: name to callable, name to oracle SQL."""

from __future__ import annotations

import importlib

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register the decorated ``(spark, sf_dir)`` callable under its name, with its oracle SQL if SQL expresses it."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


for _name in ("relational", "windows", "sql", "geography", "scalars", "series", "texts", "stored", "more", "jobs"):
    importlib.import_module(f"{__package__}.q_{_name}")
