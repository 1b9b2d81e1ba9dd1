"""Registration of queries with their SQL twins."""

from __future__ import annotations

from ..sources.views import SQL, Tables

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, recursive: bool = False):
    """Registers a function of ``Tables`` under its name; ``sql`` goes after the views' common table expressions."""

    def add(f):
        QUERIES[f.__name__] = run = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        run.mod = f.__module__
        if sql:
            ORACLE[f.__name__] = f"{SQL.rstrip()},{sql.strip().removeprefix('WITH')}" if sql.strip().startswith("WITH") else f"{SQL}{sql.strip()}"
            if recursive:
                ORACLE[f.__name__] = ORACLE[f.__name__].replace("WITH", "WITH RECURSIVE", 1)
        return f

    return add
