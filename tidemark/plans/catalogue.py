"""All queries of the core by name, and their SQL."""

from __future__ import annotations

from tidemark.operators import assistant_queries, chunking_queries, corpus_queries, crawl_queries, incremental_queries, request_queries, upkeep_queries
from tidemark.sources import html_queries

QUERIES: dict = {}
SQL: dict = {}
for _module in (assistant_queries, chunking_queries, corpus_queries, crawl_queries, html_queries, incremental_queries, request_queries, upkeep_queries):
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
