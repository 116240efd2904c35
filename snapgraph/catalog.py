"""All registered queries of the reference's operators and their SQL."""

from __future__ import annotations

from snapgraph.plans import queries_graph, queries_maps, queries_seq


def _all() -> dict:
    return queries_graph.QUERIES | queries_maps.QUERIES | queries_seq.QUERIES


def queries() -> dict:
    return {name: query for name, (query, _) in _all().items()}


def oracle_sql() -> dict:
    return {name: sql for name, (_, sql) in _all().items() if sql}
