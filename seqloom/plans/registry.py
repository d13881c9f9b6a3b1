"""All queries of the library and their SQL."""

from __future__ import annotations

from seqloom.plans import encoding_queries, head_queries, model_queries, search_queries, sequence_queries, table_queries, word_queries


def queries() -> dict:
    return sequence_queries.QUERIES | table_queries.QUERIES | word_queries.QUERIES | head_queries.QUERIES | model_queries.QUERIES | search_queries.QUERIES | encoding_queries.QUERIES


def oracle_sql() -> dict:
    return sequence_queries.ORACLE_SQL | table_queries.ORACLE_SQL | word_queries.ORACLE_SQL | head_queries.ORACLE_SQL | model_queries.ORACLE_SQL | search_queries.ORACLE_SQL | encoding_queries.ORACLE_SQL
