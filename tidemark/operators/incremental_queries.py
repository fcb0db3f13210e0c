"""Queries of the incremental operator, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators.merkle import changed_pages
from tidemark.sources.tables import table


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id of the pages whose content is new or differs from what the last completed run processed."""
    return changed_pages(table(spark, sf_dir, "pages"))


QUERIES = {"p7_found": p7_found}

SQL = {
    "p7_found": r"""
        with last as (
            select id, crawl_status, regexp_replace(lower(content_hash), '^\s*(sha256:)?\s*|\s+$', '', 'g') as h,
                   regexp_replace(lower(previous_content_hash), '^\s*(sha256:)?\s*|\s+$', '', 'g') as p,
                   row_number() over (partition by id order by crawled_at desc nulls last, crawl_status desc nulls last,
                                      content_hash desc nulls last, previous_content_hash desc nulls last) as k
            from pages where id is not null)
        select id as page_id from last
        where k = 1 and crawl_status = 'crawled' and h <> '' and (p is null or p = '' or p <> h)
    """,
}
