"""Queries of manifest, link graph, chunk store and audits, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions import urls as U
from tidemark.operators import components, corpus, merkle
from tidemark.plans.materialize import materialize
from tidemark.sources.tables import table

_AT = ["crawled_at", "crawl_status", "content_hash"]


def manifest(spark: SparkSession, d: str) -> DataFrame:
    """The latest state of each page."""
    keep = ["url", "content_type", "page_classification", "chunking_strategy", "crawl_status", "content_hash", "previous_content_hash", "word_count", "depth", "exclusion_reason", "http_status"]
    return merkle.latest(table(spark, d, "pages"), "id", "crawled_at", keep)


def url_normalize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "links").select("target_url", U.normalized(F.col("target_url"), blocked=("facebook.", "twitter.")).alias("url")).distinct()


def url_content_type(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "links").groupBy(U.content_type(F.col("target_url")).alias("kind")).agg(F.count("*").alias("links"), F.count_if(F.col("is_document") == 1).alias("marked"))


def doc_url_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").filter(F.col("source_url").isNotNull()).groupBy(U.document_key(F.col("source_url")).alias("key")).agg(F.count_distinct("chunk_id").alias("chunks"))


def case_variant_urls(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chunks").filter(F.col("source_url").isNotNull()).select("source_url").distinct()
    return rows.groupBy(F.lower("source_url").alias("low")).agg(F.count("*").alias("variants"), F.min("source_url").alias("first")).filter("variants > 1")


EXCLUDE = [
    (r"/press_room/", "press"), (r"[-_](spanish|korean|amharic)[^/]*\.(pdf|docx?)$", "translated document"), (r"-results-", "results"), (r"\.(csv|xlsx)$", "file type"), (r"/(login|search|calendar)\b", "no content"),
]


def url_exclusion_reasons(spark: SparkSession, d: str) -> DataFrame:
    reason = U.first_match(U.part(F.col("target_url"), "path"), EXCLUDE)
    return table(spark, d, "links").groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count("*").alias("links"))


CLASSES = [("faq", r"faq|frequently-asked|questions"), ("press_release", r"press_room|press-release|announcement"), ("table_data", r"results|archive|stats"), ("form", r"/forms?/|voter_registration")]


def _page_class():
    value = F.lower(F.concat_ws(" ", "url", "title"))
    out = F.when(value.contains("cdn-cgi"), "junk")
    for name, pattern in CLASSES:
        out = out.when(value.rlike(pattern), name)
    n = F.coalesce("word_count", F.lit(0))
    return out.when(n >= 500, "prose").when(n >= 150, "nav_hub").otherwise("short_static")


def page_classify(spark: SparkSession, d: str) -> DataFrame:
    n = F.coalesce("word_count", F.lit(0))
    strategy = F.when((n == 0) & (_page_class() != "junk"), "skip").when(_page_class() == "faq", "qa_pairs").when(_page_class() == "prose", "semantic").when(n >= 150, "simple").otherwise("single")
    return table(spark, d, "pages").filter(F.col("crawl_status") == "crawled").groupBy(_page_class().alias("page_class"), strategy.alias("strategy")).agg(F.count("*").alias("pages"), F.sum(n).alias("words"))


def reclassify_transitions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "pages").filter(F.col("crawl_status") == "crawled").select(F.coalesce("page_classification", F.lit("none")).alias("old"), _page_class().alias("new"))
    return rows.filter("old <> new").groupBy("old", "new").agg(F.count("*").alias("n"))


def link_unique(spark: SparkSession, d: str) -> DataFrame:
    return corpus.first_of(table(spark, d, "links").select("source_url", "target_url", "id", "link_text"), ["source_url", "target_url"], ["id"])


def inbound_links_topk(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "links").select("source_url", F.col("target_url").alias("url")).dropna().distinct()
    pages = manifest(spark, d).filter(F.col("content_type") != "html").select("url", "content_type")
    return links.join(pages, "url").groupBy("url").agg(F.count("*").alias("inbound"), F.first("content_type").alias("content_type")).orderBy(F.desc("inbound"), "url").limit(15)


def orphan_links(spark: SparkSession, d: str) -> DataFrame:
    urls = table(spark, d, "pages").select("url").dropna().distinct()
    links = table(spark, d, "links")
    known = links.join(urls.withColumnRenamed("url", "source_url"), "source_url", "left_semi").join(urls.withColumnRenamed("url", "target_url"), "target_url", "left_semi")
    return links.join(known.select("id"), "id", "left_anti").select("id")


def bfs_frontier(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "links").select(F.lower("source_url").alias("source"), F.lower("target_url").alias("target"))
    seeds = table(spark, d, "pages").filter("depth = 0 and url is not null").select(F.lower("url").alias("node"))
    out = None
    for level in corpus.frontier(links, seeds, 6):
        out = level if out is None else out.unionByName(level)
    return out


def dedup_partner_closure(spark: SparkSession, d: str) -> DataFrame:
    """Pages tied by content hashes or links to the same document, directly or over others."""
    rows = manifest(spark, d).filter(F.col("content_hash").isNotNull() & (F.col("content_hash") != "")).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("a"), F.concat(F.lit("h"), merkle.normal_digest(F.col("content_hash"))).alias("b")).dropna()
    members = components.components(rows).filter(F.col("node").startswith("p"))
    return members.groupBy("component").agg(F.count("*").alias("pages"), F.min("node").alias("first")).filter("pages > 1").select("pages", "first")


def content_hash_dedup(spark: SparkSession, d: str) -> DataFrame:
    """The page that is chunked for each content hash: the lowest id among the crawled ones that aren't skipped."""
    rows = manifest(spark, d).filter((F.col("crawl_status") == "crawled") & (F.coalesce("chunking_strategy", F.lit("")) != "skip")).select("id", merkle.normal_digest(F.col("content_hash")).alias("h"))
    return rows.dropna().groupBy("h").agg(F.min("id").alias("winner"), F.count("*").alias("pages"))


def multi_source_urls(spark: SparkSession, d: str) -> DataFrame:
    rows = manifest(spark, d).select("id", "url", merkle.normal_digest(F.col("content_hash")).alias("h")).dropna()
    grouped = rows.groupBy("h").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("id", "url"))).alias("p")).filter("n > 1")
    return grouped.select("h", "n", F.array_join(F.array_distinct(F.transform("p", lambda x: x["url"])), " ").alias("urls"))


def changed_pages(spark: SparkSession, d: str) -> DataFrame:
    rows = manifest(spark, d).filter(F.col("crawl_status") == "crawled")
    return rows.filter(corpus.needs_work(F.col("content_hash"), F.col("previous_content_hash"), F.col("content_type"), F.col("chunking_strategy"))).select("id", "content_type")


def snapshot_hashes(spark: SparkSession, d: str) -> DataFrame:
    pages = manifest(spark, d)
    covered = table(spark, d, "chunks").select(F.col("source_url").alias("url")).dropna().distinct()
    failed = pages.filter(F.col("crawl_status") == "failed").select("url")
    return corpus.clear_snapshot(corpus.snapshot(pages, materialize(covered, "covered")), materialize(failed, "failed")).select("id", "previous_content_hash")


def run_totals(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("crawl_status")
    return manifest(spark, d).agg(F.count("*").alias("total"), F.count_if(s == "crawled").alias("crawled"), F.count_if(s == "failed").alias("failed"), F.count_if(s == "excluded").alias("excluded"))


def _url_set():
    return F.array_distinct(F.filter(F.concat(F.array("source_url"), F.coalesce("source_urls", F.array().cast("array<string>"))), lambda u: u.isNotNull()))


def incremental_merge(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "chunks").select("chunk_id", _url_set().alias("urls")).dropDuplicates(["chunk_id"])
    pages = manifest(spark, d).dropna(subset=["url"])
    reprocessed, expected = pages.filter("id % 5 = 0").select("url"), pages.filter(F.col("crawl_status") == "crawled").select("url")
    new = pages.filter((F.col("id") % 5 == 0) & (F.col("crawl_status") == "crawled")).select(F.concat(F.lit("new-"), F.col("id").cast("string")).alias("chunk_id"), F.array("url").alias("urls"))
    return corpus.merge_chunks(chunks, new, reprocessed, expected).select("chunk_id", F.size("urls").alias("n_urls"))


def coverage_gap(spark: SparkSession, d: str) -> DataFrame:
    expected = manifest(spark, d).filter((F.col("crawl_status") == "crawled") & (F.col("chunking_strategy").isNull() | (F.col("chunking_strategy") != "skip"))).select("url").dropna()
    return corpus.uncovered(expected, table(spark, d, "chunks"))


def id_parity(spark: SparkSession, d: str) -> DataFrame:
    return corpus.parity(table(spark, d, "review_labels"), table(spark, d, "documents"), "doc_id")


def upsert_last_wins(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select("id", "url", "crawl_status", "content_hash", "crawled_at")
    old, new = pages.filter("id % 3 <> 0"), pages.filter("id % 2 = 0")
    base = corpus.first_of(old, ["id"], ["crawled_at", "crawl_status", "content_hash", "url"])
    return corpus.upsert(base, new, "id", _AT).select("id", "crawl_status", "content_hash")


def insert_or_ignore(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "links").select("source_url", "target_url", "id")
    base = corpus.first_of(links.filter("id % 4 = 0"), ["source_url", "target_url"], ["id"])
    return corpus.insert_or_ignore(base, links, ["source_url", "target_url"], ["id"]).select("source_url", "target_url", "id")


def coalesce_update(spark: SparkSession, d: str) -> DataFrame:
    pages = manifest(spark, d)
    new = pages.select("id", F.when(F.col("id") % 3 == 0, F.lit("fresh")).alias("content_hash"))
    return corpus.coalesce_update(pages.select("id", "content_hash"), new, "id", ["content_hash"]).groupBy("content_hash").agg(F.count("*").alias("n"))


def manifest_merge(spark: SparkSession, d: str) -> DataFrame:
    pages = manifest(spark, d).dropna(subset=["url"])
    old = pages.filter("id % 2 = 0").select("url", F.when(F.col("id") % 4 == 0, "").otherwise(F.col("crawl_status")).alias("value"))
    new = pages.filter("id % 3 <> 1").select("url", F.upper("crawl_status").alias("value"))
    return corpus.additive_merge(old, new, "url", "value")


def download_plan(spark: SparkSession, d: str) -> DataFrame:
    pages = manifest(spark, d)
    state = pages.filter("id % 7 <> 0").select("id", F.col("previous_content_hash").alias("h"))
    listing = pages.filter("id % 11 <> 0").select("id", F.col("content_hash").alias("h"))
    return corpus.transfer_plan(listing, state, "id", "h").groupBy("plan").agg(F.count("*").alias("n"))


def filename_filter(spark: SparkSession, d: str) -> DataFrame:
    name = F.lower(F.regexp_extract("url", r"([^/]+)$", 1))
    decision = F.when(name.rlike(r"ballot|judge|voter"), "include").when(name.rlike(r"results|survey|drill"), "exclude").otherwise("review")
    return manifest(spark, d).groupBy(decision.alias("decision")).agg(F.count("*").alias("n"))


def cleanup_plan(spark: SparkSession, d: str) -> DataFrame:
    """Rows that each of the ordered deletions would remove by itself, and does remove after those before it."""
    host, u = U.part(F.col("url"), "host"), F.col("url")
    rules = {"http": u.startswith("http://"), "www": host.startswith("www."), "cdn": u.contains("cdn-cgi"), "external": ~host.contains("calderstate"), "failed": F.coalesce(F.col("crawl_status") == "failed", F.lit(False))}
    first = None
    for name, rule in rules.items():
        first = F.when(rule, name) if first is None else first.when(rule, name)
    rows = manifest(spark, d).dropna(subset=["url"]).withColumn("first", first)
    sums = rows.agg(*[F.count_if(rule).alias(f"planned_{n}") for n, rule in rules.items()], *[F.count_if(F.col("first") == n).alias(f"removed_{n}") for n in rules])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"planned_{n}").alias("planned"), F.col(f"removed_{n}").alias("removed")) for n in rules])).alias("r")).select("r.*")


def audit_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return manifest(spark, d).filter(F.col("crawl_status") == "crawled").groupBy("page_classification", "chunking_strategy", "content_type").agg(F.count("*").alias("n"), F.round(F.avg("word_count")).alias("mean_words"), F.max("word_count").alias("most_words"))


def audit_exclusions(spark: SparkSession, d: str) -> DataFrame:
    return manifest(spark, d).filter(F.col("crawl_status") == "excluded").groupBy("exclusion_reason").agg(F.count("*").alias("n"))


def depth_histogram(spark: SparkSession, d: str) -> DataFrame:
    return manifest(spark, d).groupBy("depth").agg(F.count("*").alias("n"))


def leak_check(spark: SparkSession, d: str) -> DataFrame:
    return manifest(spark, d).filter((F.col("crawl_status") == "crawled") & (F.col("url").like("%/press_room/%") | F.col("url").like("%cdn-cgi%"))).select("id", "url")


def largest_candidates(spark: SparkSession, d: str) -> DataFrame:
    return manifest(spark, d).filter(F.col("chunking_strategy") == "semantic_with_overlap").orderBy(F.desc_nulls_last("word_count"), "id").limit(15).select("id", "word_count")


def junk_report(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    empty = t.isNull() | (T.squeezed(t) == "")
    es, other = T.is_spanish(t), T.is_foreign(t)
    return table(spark, d, "chunks").select("chunk_id", "text").distinct().agg(
        F.count("*").alias("chunks"), F.count_if(empty).alias("empty"), F.count_if(~empty & (F.length(t) > 20000)).alias("long"), F.count_if(~empty & (T.word_count(t) > 500)).alias("wordy"),
        F.count_if(~empty & es).alias("spanish"), F.count_if(~empty & other & ~es).alias("foreign"), F.count_if(~empty & t.contains("None:")).alias("nones"),
    )


def nav_boilerplate(spark: SparkSession, d: str) -> DataFrame:
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    bullets = F.size(F.filter(lines, lambda x: x.rlike(r"^[-*•]") & (F.size(F.split(x, " +")) <= 5)))
    menu = (F.size(lines) >= 10) & (bullets / F.size(lines) > 0.5)
    return table(spark, d, "chunks").filter(F.col("text").isNotNull() & (F.col("text").startswith("Skip to Content") | menu)).select("chunk_id").distinct()


def length_bands(spark: SparkSession, d: str) -> DataFrame:
    n = F.length("text")
    return table(spark, d, "chunks").groupBy(F.when(n.isNull(), "null").when(n < 50, "short").when(n > 8000, "long").otherwise("good").alias("band")).agg(F.count("*").alias("n"))


def duplicate_chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chunks").groupBy("chunk_id").agg(F.count("*").alias("n"), F.count_distinct(U.document_key(F.col("source_url"))).alias("documents"))
    return rows.filter("n > 1").select("chunk_id", "n", "documents")


QUERIES = {
    f.__name__: f
    for f in (
        url_normalize, url_content_type, doc_url_key, case_variant_urls, url_exclusion_reasons, page_classify, reclassify_transitions, link_unique, inbound_links_topk, orphan_links, bfs_frontier, dedup_partner_closure,
        content_hash_dedup, multi_source_urls, changed_pages, snapshot_hashes, run_totals, incremental_merge, coverage_gap, id_parity, upsert_last_wins, insert_or_ignore, coalesce_update, manifest_merge, download_plan,
        filename_filter, cleanup_plan, audit_breakdown, audit_exclusions, depth_histogram, leak_check, largest_candidates, junk_report, nav_boilerplate, length_bands, duplicate_chunk_ids,
    )
}

_M = """with m as (
    select * from (select *, row_number() over (partition by id order by crawled_at desc nulls last, url desc nulls last, content_type desc nulls last, page_classification desc nulls last, chunking_strategy desc nulls last,
        crawl_status desc nulls last, content_hash desc nulls last, previous_content_hash desc nulls last, word_count desc nulls last) as k from pages where id is not null) where k = 1)
"""
_RE = r"'^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?'"
_NORM = r"nullif(regexp_replace(lower({0}), '^\s*(sha256:)?\s*|\s+$', '', 'g'), '')"
_KEY = r"lower(url_decode(regexp_replace(string_split(string_split({0}, '#')[1], '?')[1], '/+$', '')))"
_CLASS = "case when v like '%cdn-cgi%' then 'junk' " + " ".join(f"when regexp_matches(v, '{p}') then '{n}'" for n, p in CLASSES) + " when coalesce(word_count, 0) >= 500 then 'prose' when coalesce(word_count, 0) >= 150 then 'nav_hub' else 'short_static' end"
_PAGES = f"(select *, {_CLASS} as pc from (select *, lower(concat_ws(' ', url, title)) as v from pages where crawl_status = 'crawled'))"
_SP, _EN = ", ".join(f"'{w}'" for w in T.SPANISH), ", ".join(f"'{w}'" for w in T.ENGLISH)
_URLS = "list_distinct(list_filter(list_concat([source_url], coalesce(source_urls, [])), lambda u: u is not null))"
SQL = {
    "url_normalize": rf"""
        with p as (select distinct target_url, lower(regexp_extract(trim(target_url), {_RE}, 2)) as s, lower(regexp_extract(trim(target_url), {_RE}, 4)) as h, regexp_extract(trim(target_url), {_RE}, 5) as path, regexp_extract(trim(target_url), {_RE}, 7) as q from links)
        select target_url, case when s in ('http', 'https') and h <> '' and h not like '%facebook.%' and h not like '%twitter.%' then s || '://' || h || path
            || case when q <> '' then '?' || array_to_string(list_sort(list_filter(string_split(q, '&'), lambda x: x <> '')), '&') else '' end end as url from p""",
    "url_content_type": rf"""
        with p as (select lower(regexp_extract(regexp_extract(target_url, {_RE}, 5), '\.([^./]+)$', 1)) as e, is_document from links)
        select case when e in ('pdf', 'docx', 'doc', 'xls', 'xlsx', 'csv') then e else 'html' end as kind, count(*) as links, count(*) filter (is_document = 1) as marked from p group by 1""",
    "doc_url_key": f"select {_KEY.format('source_url')} as key, count(distinct chunk_id) as chunks from chunks where source_url is not null group by 1",
    "case_variant_urls": "select lower(source_url) as low, count(*) as variants, min(source_url) as first from (select distinct source_url from chunks where source_url is not null) group by 1 having count(*) > 1",
    "url_exclusion_reasons": f"select case {' '.join(f'when regexp_matches(p, {chr(39)}(?i){x}{chr(39)}) then {chr(39)}{y}{chr(39)}' for x, y in EXCLUDE)} else 'kept' end as reason, count(*) as links from (select regexp_extract(target_url, {_RE}, 5) as p from links) group by 1",
    "page_classify": f"select pc as page_class, case when coalesce(word_count, 0) = 0 and pc <> 'junk' then 'skip' when pc = 'faq' then 'qa_pairs' when pc = 'prose' then 'semantic' when coalesce(word_count, 0) >= 150 then 'simple' else 'single' end as strategy, count(*) as pages, sum(coalesce(word_count, 0))::bigint as words from {_PAGES} group by 1, 2",
    "reclassify_transitions": f"select coalesce(page_classification, 'none') as old, pc as new, count(*) as n from {_PAGES} where coalesce(page_classification, 'none') <> pc group by 1, 2",
    "link_unique": "select source_url, target_url, id, link_text from (select *, row_number() over (partition by source_url, target_url order by id, link_text nulls first) as k from links where source_url is not null and target_url is not null) where k = 1",
    "inbound_links_topk": _M + "select m.url, count(*) as inbound, min(content_type) as content_type from m join (select distinct source_url, target_url from links where source_url is not null and target_url is not null) l on l.target_url = m.url where content_type <> 'html' group by m.url order by inbound desc, m.url limit 15",
    "orphan_links": "select id from links where source_url is null or target_url is null or source_url not in (select url from pages where url is not null) or target_url not in (select url from pages where url is not null)",
    "bfs_frontier": """
        with recursive e as (select distinct lower(source_url) as s, lower(target_url) as t from links where source_url is not null and target_url is not null),
        w as (select distinct lower(url) as node, 0 as depth from pages where depth = 0 and url is not null
              union select e.t, w.depth + 1 from w join e on e.s = w.node where w.depth < 6)
        select node, min(depth)::int as depth from w group by node""",
    "dedup_partner_closure": _M + f"select count(*) as pages, min('p' || id) as first from (select id, {_NORM.format('content_hash')} as h from m) where h is not null group by h having count(*) > 1",
    "content_hash_dedup": _M + f"select h, min(id) as winner, count(*) as pages from (select id, {_NORM.format('content_hash')} as h from m where crawl_status = 'crawled' and coalesce(chunking_strategy, '') <> 'skip') where h is not null group by h",
    "multi_source_urls": _M + f"select h, count(*) as n, string_agg(url, ' ' order by id) as urls from (select id, url, {_NORM.format('content_hash')} as h from m) where h is not null and url is not null group by h having count(*) > 1",
    "changed_pages": _M + "select id, content_type from m where crawl_status = 'crawled' and (previous_content_hash is null or (content_hash is not null and content_hash <> previous_content_hash) or (content_type <> 'html' and coalesce(chunking_strategy, '') <> 'skip'))",
    "snapshot_hashes": _M + "select id, case when url in (select url from m where crawl_status = 'failed' and url is not null) then null when url in (select source_url from chunks where source_url is not null) then coalesce(content_hash, previous_content_hash) else previous_content_hash end as previous_content_hash from m",
    "run_totals": _M + "select count(*) as total, count(*) filter (crawl_status = 'crawled') as crawled, count(*) filter (crawl_status = 'failed') as failed, count(*) filter (crawl_status = 'excluded') as excluded from m",
    "incremental_merge": _M + f""", c as (select chunk_id, any_value(u) as u from (select chunk_id, {_URLS} as u from chunks) where chunk_id is not null group by chunk_id),
        e as (select chunk_id, unnest(u) as url from c)
        select chunk_id, len(u)::int as n_urls from c where chunk_id not in (select chunk_id from e where url in (select url from m where id % 5 = 0 and url is not null)) and chunk_id in (select chunk_id from e where url in (select url from m where crawl_status = 'crawled' and url is not null))
        union all select 'new-' || id, 1 from m where id % 5 = 0 and crawl_status = 'crawled' and url is not null""",
    "coverage_gap": _M + f"select distinct url from m where crawl_status = 'crawled' and (chunking_strategy is null or chunking_strategy <> 'skip') and url is not null and url not in (select unnest({_URLS}) from chunks)",
    "id_parity": """
        select doc_id, 'missing' as side from (select distinct doc_id from review_labels where doc_id is not null) where doc_id not in (select doc_id from documents)
        union all select doc_id, 'orphan' from (select distinct doc_id from documents where doc_id is not null) where doc_id not in (select doc_id from review_labels where doc_id is not null)""",
    "upsert_last_wins": """
        with n as (select *, row_number() over (partition by id order by crawled_at desc nulls last, crawl_status desc nulls last, content_hash desc nulls last, url desc nulls last) as k from pages where id % 2 = 0),
        o as (select *, row_number() over (partition by id order by crawled_at nulls first, crawl_status nulls first, content_hash nulls first, url nulls first) as k from pages where id % 3 <> 0)
        select id, crawl_status, content_hash from n where k = 1 union all select id, crawl_status, content_hash from o where k = 1 and id not in (select id from n)""",
    "insert_or_ignore": """
        with l as (select * from links where source_url is not null and target_url is not null), o as (select source_url, target_url, min(id) as id from l where id % 4 = 0 group by 1, 2)
        select * from o union all select source_url, target_url, min(id) as id from l anti join o using (source_url, target_url) group by 1, 2""",
    "coalesce_update": _M + "select case when id % 3 = 0 then 'fresh' else content_hash end as content_hash, count(*) as n from m group by 1",
    "manifest_merge": _M + """, o as (select url, case when id % 4 = 0 then '' else crawl_status end as v from m where url is not null and id % 2 = 0), n as (select url, upper(crawl_status) as v from m where url is not null and id % 3 <> 1)
        select coalesce(o.url, n.url) as url, coalesce(nullif(o.v, ''), n.v, o.v) as value, case when o.url is null then 'added' when coalesce(o.v, '') = '' and coalesce(n.v, '') <> '' then 'filled' else 'kept' end as outcome from o full join n on o.url = n.url""",
    "download_plan": _M + """, s as (select id, previous_content_hash as h from m where id % 7 <> 0), l as (select id, content_hash as h from m where id % 11 <> 0)
        select case when s.id is null then 'new' when l.id is null then 'gone' when l.h is not distinct from s.h then 'unchanged' else 'updated' end as plan, count(*) as n from l full join s on l.id = s.id group by 1""",
    "filename_filter": _M + "select case when regexp_matches(f, 'ballot|judge|voter') then 'include' when regexp_matches(f, 'results|survey|drill') then 'exclude' else 'review' end as decision, count(*) as n from (select lower(regexp_extract(url, '([^/]+)$', 1)) as f from m) group by 1",
    "cleanup_plan": _M + f""", r as (select [url like 'http://%', h like 'www.%', url like '%cdn-cgi%', h not like '%calderstate%', coalesce(crawl_status = 'failed', false)] as hit from (select *, regexp_extract(url, {_RE}, 4) as h from m where url is not null)),
        n as (select unnest(['http', 'www', 'cdn', 'external', 'failed']) as rule, unnest([1, 2, 3, 4, 5]) as i)
        select rule, count(*) filter (hit[i]) as planned, count(*) filter (list_position(hit, true) = i) as removed from n cross join r group by rule""",
    "audit_breakdown": _M + "select page_classification, chunking_strategy, content_type, count(*) as n, round(avg(word_count)) as mean_words, max(word_count) as most_words from m where crawl_status = 'crawled' group by 1, 2, 3",
    "audit_exclusions": _M + "select exclusion_reason, count(*) as n from m where crawl_status = 'excluded' group by 1",
    "depth_histogram": _M + "select depth, count(*) as n from m group by 1",
    "leak_check": _M + "select id, url from m where crawl_status = 'crawled' and (url like '%/press_room/%' or url like '%cdn-cgi%')",
    "largest_candidates": _M + "select id, word_count from m where chunking_strategy = 'semantic_with_overlap' order by word_count desc nulls last, id limit 15",
    "junk_report": rf"""
        with c as (select distinct chunk_id, text from chunks), x as (
            select text, text is null or trim(regexp_replace(text, '[\s\x{{A0}}\x{{3000}}\x{{2000}}-\x{{200A}}\x{{85}}]+', ' ', 'g')) = '' as empty, regexp_extract_all(lower(text), '[a-záéíóúüñ]+') as w, regexp_replace(text, '[^\p{{L}}]', '', 'g') as l,
                   len(list_filter(string_split(trim(regexp_replace(text, '[\s\x0B\x1C-\x1F\x{{A0}}\x{{3000}}\x{{2000}}-\x{{200A}}\x{{85}}]+', ' ', 'g')), ' '), lambda y: y <> '')) as n from c),
        y as (select *, len(w) >= 30 and len(list_filter(w, lambda q: q in ({_SP}))) / nullif(len(w), 0) >= 0.2 and len(list_filter(w, lambda q: q in ({_EN}))) / nullif(len(w), 0) < 0.05 as es,
                     length(regexp_replace(l, '[\x{{0}}-\x{{24F}}]', '', 'g')) as nf from x)
        select count(*) as chunks, count(*) filter (empty) as empty, count(*) filter (not empty and length(text) > 20000) as long, count(*) filter (not empty and n > 500) as wordy, count(*) filter (not empty and es) as spanish,
               count(*) filter (not empty and nf >= 15 and nf / length(l) > 0.1 and not es) as "foreign", count(*) filter (not empty and text like '%None:%') as nones from y""",
    "nav_boilerplate": r"""
        with c as (select chunk_id, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') as l from chunks where text is not null)
        select distinct chunk_id from c where text like 'Skip to Content%' or (len(l) >= 10 and len(list_filter(l, lambda x: regexp_matches(x, '^[-*•]') and len(regexp_split_to_array(x, ' +')) <= 5)) / len(l) > 0.5)""",
    "length_bands": "select case when text is null then 'null' when length(text) < 50 then 'short' when length(text) > 8000 then 'long' else 'good' end as band, count(*) as n from chunks group by 1",
    "duplicate_chunk_ids": f"select chunk_id, count(*) as n, count(distinct {_KEY.format('source_url')}) as documents from chunks group by chunk_id having count(*) > 1",
}
