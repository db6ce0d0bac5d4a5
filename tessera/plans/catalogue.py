"""Every query of the library with the SQL that it must match."""

from __future__ import annotations

from tessera.plans import derived_queries, desk_queries, page_queries, posting_queries, reader_queries, relational_queries, state_queries, text_queries, transition_queries

QUERIES: dict = relational_queries.QUERIES | text_queries.QUERIES | page_queries.QUERIES | posting_queries.QUERIES | reader_queries.QUERIES | derived_queries.QUERIES | state_queries.QUERIES | transition_queries.QUERIES | desk_queries.QUERIES
ORACLE_SQL: dict[str, str] = relational_queries.SQL | text_queries.SQL | page_queries.SQL | posting_queries.SQL | reader_queries.SQL | derived_queries.SQL | state_queries.SQL | transition_queries.SQL | desk_queries.SQL
FLAGSHIP = "top_nations_by_open_orders"
