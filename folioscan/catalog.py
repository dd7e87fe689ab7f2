"""All registered queries of the library's own operators, with their SQL."""

from __future__ import annotations

from folioscan.plans import assembly_queries, document_queries, retrieval_queries, text_queries


def queries() -> dict:
    return {**text_queries.QUERIES, **retrieval_queries.QUERIES, **assembly_queries.QUERIES, **document_queries.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**text_queries.SQL, **retrieval_queries.SQL, **assembly_queries.SQL, **document_queries.SQL}
