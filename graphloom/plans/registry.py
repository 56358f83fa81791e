"""Queries of a module with the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TRIM = "lower(trim({0}, ' \t\n\r\x0b\x0c\xa0'))"
#: The graph in SQL: n nodes, e edges with the last of re-sent relations at the place of the first, s one edge per ordered pair.
GRAPH = f"""n AS (SELECT {TRIM.format('id')} AS id, {TRIM.format('parent_id')} AS parent_id, * EXCLUDE (id, parent_id) FROM graph_nodes),
e0 AS (SELECT {TRIM.format('source_id')} AS source_id, {TRIM.format('target_id')} AS target_id, type, description, provenance, confidence, is_stale, weight, conditional, location, metadata, edge_id FROM graph_edges WHERE source_id IS NOT NULL AND target_id IS NOT NULL),
e AS (SELECT * EXCLUDE (k, edge_id) FROM (SELECT *, row_number() OVER (PARTITION BY source_id, target_id, type ORDER BY edge_id DESC) AS k, min(edge_id) OVER (PARTITION BY source_id, target_id, type) AS ord FROM e0) WHERE k = 1),
s AS (SELECT source_id, target_id, arg_max(type, ord) AS type, arg_max(weight, ord) AS weight, max(ord) AS ord FROM e GROUP BY ALL)"""


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None, ctes: str = GRAPH, recursive: bool = False):
        """Registers a function; sql may follow the given CTEs, with further ones of its own if it starts with a comma."""

        def wrap(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
            self.queries[f.__name__] = f
            if sql is not None:
                head = f"WITH {'RECURSIVE ' if recursive else ''}{ctes}" if ctes else ""
                self.sql[f.__name__] = f"{head}{sql if sql.startswith(',') else ' ' + sql}"
            return f

        return wrap
