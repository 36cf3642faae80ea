"""Where queries and their SQL twins are registered by name."""

from __future__ import annotations

from . import demo_graph as g

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, graph_sql: bool = True):
    """Registers a function by its name; sql continues the graph's WITH clause if graph_sql."""
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = (g.SQL + sql) if graph_sql else sql
        return f

    return register
