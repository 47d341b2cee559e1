"""The registered queries of the library and their SQL."""

from __future__ import annotations

from tesseral.plans import model_queries, panel_queries

QUERIES: dict = {**panel_queries.QUERIES, **model_queries.QUERIES}
ORACLE_SQL: dict = {**panel_queries.ORACLE_SQL, **model_queries.ORACLE_SQL}
