"""All registered queries of the volume engine."""

from __future__ import annotations

from voxlake.plans import file_queries, queries

QUERIES = queries.QUERIES | file_queries.QUERIES
SQL = queries.SQL | file_queries.SQL
