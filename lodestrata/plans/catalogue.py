"""All queries over the driver's tables, by name, and the SQL that each must equal."""

from __future__ import annotations

from . import edge_queries, mechanism_queries, record_queries, text_queries

FLAGSHIP = "recommend_ladder"
QUERIES = {**text_queries.QUERIES, **record_queries.QUERIES, **mechanism_queries.QUERIES, **edge_queries.QUERIES}
SQL = {**text_queries.SQL, **record_queries.SQL, **mechanism_queries.SQL, **edge_queries.SQL}
