"""All queries of the library proper, with the SQL that checks them."""

from __future__ import annotations

from vecloom.plans import extra_queries, more_queries, ops_queries, stream_queries, text_queries, vector_queries

_REGISTRIES = [vector_queries.REG, text_queries.REG, ops_queries.REG, stream_queries.REG, more_queries.REG, extra_queries.REG]
FLAGSHIP = "rrf_hybrid"


def queries() -> dict:
    return {name: f for r in _REGISTRIES for name, f in r.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: s for r in _REGISTRIES for name, s in r.sql.items()}
