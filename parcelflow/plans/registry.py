"""Every registered query of the deal engine and its SQL."""

from __future__ import annotations

from parcelflow.plans import deal_queries, document_queries, flow_queries, function_queries, state_queries

PARTS = (function_queries, deal_queries, state_queries, flow_queries, document_queries)


def queries() -> dict:
    return {k: v for p in PARTS for k, v in p.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for p in PARTS for k, v in p.oracle_sql().items()}
