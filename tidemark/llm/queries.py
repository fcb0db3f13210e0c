"""The queries of this subpackage by name, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import conduct, mixing, near_duplicates, page_content, quality, repeated_lines, residue, scanned, tokens
from tidemark.plans.materialize import spread
from tidemark.sources.tables import table


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("chunk_id", "source_url", "title", "page_classification", "text")
    return spread(table(spark, sf_dir, "chunks").select(*columns), "chunk_id")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "doc_id")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "pages").select("id", "content_type", "crawl_status", "extracted_snippet", "title"), "id")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_lines.find_repeated_lines(_chunks(spark, sf_dir))


def p1_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_lines.without_repeated_lines(_chunks(spark, sf_dir))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = near_duplicates.near_duplicate_pairs(_chunks(spark, sf_dir))
    return pairs.withColumnsRenamed({"a": "chunk_a", "b": "chunk_b"})


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicate_groups(_chunks(spark, sf_dir))


def p2_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicate_links(_chunks(spark, sf_dir))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.find_no_prose(_chunks(spark, sf_dir))


def p3_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.statistics(_chunks(spark, sf_dir), title="title", kind="page_classification")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_content.find_boilerplate(_chunks(spark, sf_dir), _pages(spark, sf_dir))


def p4_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_content.main_content(_chunks(spark, sf_dir), _pages(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned.find_defects(_chunks(spark, sf_dir))


def p5_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned.repair(_chunks(spark, sf_dir))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.find_residue(_chunks(spark, sf_dir))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_table(_documents(spark, sf_dir))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir), table(spark, sf_dir, "source_targets"))[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir), table(spark, sf_dir, "source_targets"))[1]


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conduct.find_abuse(_documents(spark, sf_dir), table(spark, sf_dir, "review_labels"))


def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conduct.score(_documents(spark, sf_dir), table(spark, sf_dir, "review_labels"))


def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conduct.rates(_documents(spark, sf_dir), table(spark, sf_dir, "review_labels"))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_cleaned, p2_found, p2_groups, p2_links, p3_found, p3_statistics, p4_found, p4_content, p5_found, p5_repaired, p6_found, p8_ids, p9_mix, p9_shares, p10_found, p10_scores, p10_rates,
    )
}

_P1 = r"""
    with c as (
        select distinct chunk_id, text, regexp_replace(regexp_extract(lower(source_url), '//([^/?#:]*)', 1), '^www\.', '') as site
        from chunks where source_url is not null),
    total as (select site, count(*) as total from c group by site),
    line as (
        select chunk_id, site, unnest(range(len(l)))::int as line_no, unnest(l) as line
        from (select chunk_id, site, string_split(text, chr(10)) as l from c where text is not null)),
    keyed as (select chunk_id, site, line_no, line, regexp_replace(lower(line), '[^\p{L}]', '', 'g') as k from line),
    often as (
        select site, k from keyed join total using (site) where length(k) >= 12
        group by site, k having count(distinct chunk_id) >= 5 and count(distinct chunk_id) >= 0.05 * max(total)),
"""
SQL = {
    "p1_found": _P1 + " hit as (select chunk_id, line_no from keyed semi join often using (site, k)) select chunk_id, line_no from hit",
    "p1_cleaned": _P1 + r"""
        kept as (select chunk_id, string_agg(line, chr(10) order by line_no) as text, count(*) as n from keyed anti join often using (site, k) group by chunk_id),
        had as (select chunk_id, count(*) as n from keyed group by chunk_id)
        select distinct chunk_id, case when c.text is null then null when source_url is null then c.text else coalesce(kept.text, '') end as text,
               case when c.text is null then null when source_url is null then 0 else had.n - coalesce(kept.n, 0) end as removed
        from chunks c left join kept using (chunk_id) left join had using (chunk_id)
    """,
}
