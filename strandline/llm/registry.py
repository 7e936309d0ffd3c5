"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from strandline.llm import queries_dedup, queries_quality, queries_search, queries_tokens

MODULES = (queries_dedup, queries_quality, queries_search, queries_tokens)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
