"""Queries of the crawl policy, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import urls as U
from tidemark.operators import crawl
from tidemark.operators.corpus_queries import _M, _RE, manifest
from tidemark.sources.tables import table

#: Rules over the path, in order; and what is let in whatever the rules say.
RULES = [
    (r"/press_room/.*-report-of-", "old report"), (r"/(?:login|search)\b", "no content"), (r"-results-", "results"), (r"\.csv$", "raw data"), (r"/(?:about|voting)/how-", "how-to"),
]
ALLOWED_PREFIXES = ["https://judges.pellhaven.example/", "https://elections.calderstate.example/about/"]
INTERNAL = "calderstate"
ROBOTS = [("elections.calderstate.example", "/voting/", False), ("elections.calderstate.example", "/voting/how-", True), ("mcg.tollvaleco.example", "/", False), ("mcg.tollvaleco.example", "/voter_registration/", True)]


def _reason(url="url"):
    return crawl.exclusion(F.col(url), RULES, prefixes=ALLOWED_PREFIXES)


def url_gate(spark: SparkSession, d: str) -> DataFrame:
    """Links by the gate's decision on their targets."""
    reason = F.coalesce(_reason("target_url"), F.lit("kept"))
    return table(spark, d, "links").groupBy(reason.alias("reason")).agg(F.count("*").alias("links"), F.count_distinct("target_url").alias("urls"))


def pending_frontier(spark: SparkSession, d: str) -> DataFrame:
    """The pages to crawl next, by depth and then id, with their place."""
    from pyspark.sql.window import Window

    rows = manifest(spark, d).filter(F.col("crawl_status") == "pending").select("id", "url", "depth")
    # places by ranges: counts per depth first, ranks within a depth after that
    before = rows.groupBy("depth").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("depth").orderBy("id"))
    return rows.join(F.broadcast(before.select("depth", "before")), "depth").select("id", "url", "depth", (rank + F.col("before")).alias("place"))


def pages_by_url_list(spark: SparkSession, d: str) -> DataFrame:
    """The crawled pages that some link names as a document."""
    named = table(spark, d, "links").filter("is_document = 1").select(F.col("target_url").alias("url")).dropna().distinct()
    return manifest(spark, d).filter(F.col("crawl_status") == "crawled").join(named, "url", "left_semi").select("id", "url")


def status_classes(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("http_status")
    return table(spark, d, "pages").groupBy("http_status").agg(
        F.first(crawl.status_class(s)).alias("class"), F.first(crawl.repeats(s)).alias("repeats"), F.first(F.coalesce(s.isin(*crawl.EXCLUDED_STATUS), F.lit(False))).alias("excluded"), F.count("*").alias("n")
    )


def crawl_gates(spark: SparkSession, d: str) -> DataFrame:
    """Pages by their status and the one that the gates give them."""
    host = U.part(F.col("url"), "host")
    new = crawl.gate(F.col("depth"), _reason(), host.startswith("mcg."), F.col("http_status"), U.is_internal(F.col("url"), INTERNAL), F.col("crawl_status"), most_depth=4)
    return manifest(spark, d).groupBy("crawl_status", new.alias("new_status")).agg(F.count("*").alias("n"))


def retroactive_exclusion(spark: SparkSession, d: str) -> DataFrame:
    """Crawled and failed pages that today's rules would keep out."""
    return manifest(spark, d).filter(F.col("crawl_status").isin("crawled", "failed")).select("id", _reason().alias("reason")).filter("reason is not null")


def crawl_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Crawled pages that no chunk came from, judged as if the chunks' URLs were those that a run fetched, in another case for every seventh."""
    fetched = table(spark, d, "chunks").select(F.when(F.pmod(F.length("source_url"), F.lit(7)) == 0, F.upper("source_url")).otherwise(F.col("source_url")).alias("url")).dropna()
    return crawl.sweep(manifest(spark, d).select("id", "url", "crawl_status"), fetched, 0)


def status_merge(spark: SparkSession, d: str) -> DataFrame:
    new = F.when(F.col("id") % 3 == 0, "failed").when(F.col("id") % 3 == 1, "crawled")
    return manifest(spark, d).groupBy("crawl_status", crawl.merged_status(F.col("crawl_status"), new).alias("merged")).agg(F.count("*").alias("n"))


def robots_states(spark: SparkSession, d: str) -> DataFrame:
    """Hosts of the manifest by what three tries of their first pages say."""
    rows = table(spark, d, "pages").select(U.part(F.col("url"), "host").alias("host"), F.col("http_status").alias("status"), "depth", "id").filter("depth >= 5")
    return crawl.robots_state(rows)


def robots_barred(spark: SparkSession, d: str) -> DataFrame:
    rules = spark.createDataFrame(ROBOTS, "host string, prefix string, allow boolean")
    urls = manifest(spark, d).select("id", U.part(F.col("url"), "host").alias("host"), U.part(F.col("url"), "path").alias("path"))
    return crawl.barred_by_robots(urls, F.broadcast(rules)).groupBy("host", "barred").agg(F.count("*").alias("n"))


def document_probe(spark: SparkSession, d: str) -> DataFrame:
    title, hierarchy = crawl.probe(F.col("url"))
    return manifest(spark, d).filter(F.col("content_type") != "html").select("id", title.alias("title"), F.array_join(hierarchy, "/").alias("above"))


def cache_revalidation(spark: SparkSession, d: str) -> DataFrame:
    """Outcomes of the cache for the manifest's pages, two runs, with entries and answers by id."""
    pages = manifest(spark, d).filter("url is not null").select("id", "url")
    requests = pages.select(F.explode(F.array(F.lit(1), F.lit(2), F.lit(2))).alias("run"), "url")
    cache = pages.filter("id % 4 <> 0").select("url", F.lit(1).alias("version"), F.when(F.col("id") % 4 != 1, "e").alias("etag"))
    answers = pages.select(F.explode(F.array(F.lit(1), F.lit(2))).alias("run"), "url", F.col("id"))
    status = F.when(F.col("id") % 3 == 0, 304).when(F.col("id") % 3 == 1, 200).when(F.col("run") == 2, 503)
    answers = answers.select("run", "url", status.alias("status"), F.lit(2).alias("version"))
    return crawl.revalidated(requests, cache, answers).groupBy("run", "outcome", "version").agg(F.count("*").alias("n"))


def cache_entries(spark: SparkSession, d: str) -> DataFrame:
    """Keys of the pages' cache entries after those without a content hash are purged."""
    entries = manifest(spark, d).filter("url is not null").select("url", "content_hash")
    return crawl.purged(entries, F.col("content_hash") != "")[0].select(crawl.cache_key(F.col("url")).alias("key"))


def run_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    """Runs with the failed run 3 finished."""
    done = crawl.finished_run(table(spark, d, "crawl_runs"), manifest(spark, d), F.lit(3), F.lit("2026-01-01 00:00:00").cast("timestamp_ntz"))
    return done.select("id", "completed_at", "total_discovered", "total_crawled", "total_failed", "total_excluded")


def status_and_hash_updates(spark: SparkSession, d: str) -> DataFrame:
    """A keyed update of status and reason, and of documents' hashes, as one projection."""
    pages = manifest(spark, d)
    doc = F.col("content_type") != "html"
    return pages.select(
        "id", F.when(F.col("id") % 10 == 0, "excluded").otherwise(F.col("crawl_status")).alias("crawl_status"), F.when(F.col("id") % 10 == 0, "by hand").otherwise(F.col("exclusion_reason")).alias("exclusion_reason"),
        F.when(doc & (F.col("id") % 2 == 0), F.sha2(F.col("url"), 256)).otherwise(F.col("content_hash")).alias("content_hash"),
    )


def manifest_lookup(spark: SparkSession, d: str) -> DataFrame:
    """For every link's target: whether the manifest has it, its status and hash."""
    wanted = table(spark, d, "links").select(F.col("target_url").alias("url")).dropna().distinct()
    pages = manifest(spark, d).select("url", "crawl_status", F.col("content_hash").isNotNull().alias("hashed"), F.lit(True).alias("there")).dropna(subset=["url"])
    both = wanted.join(pages, "url", "left")
    return both.groupBy(F.coalesce("there", F.lit(False)).alias("there"), "crawl_status", "hashed").agg(F.count("*").alias("n"))


def first_casing_urls(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "links").select("id", F.when(F.col("id") % 5 == 0, F.upper("target_url")).otherwise(F.col("target_url")).alias("url"))
    return crawl.first_casing(rows, "url", "id").groupBy("url").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        url_gate, pending_frontier, pages_by_url_list, status_classes, crawl_gates, retroactive_exclusion, crawl_sweep, status_merge, robots_states, robots_barred, document_probe, cache_revalidation, cache_entries,
        run_lifecycle, status_and_hash_updates, manifest_lookup, first_casing_urls,
    )
}


def _path(url: str) -> str:
    return f"regexp_extract({url}, {_RE}, 5)"


def _sql_reason(url: str) -> str:
    rules = " ".join(f"when regexp_matches({_path(url)}, '(?i){p}') then '{n}'" for p, n in RULES)
    skipped = ", ".join(f"'{e}'" for e in crawl.SKIPPED_EXTENSIONS)
    extension = rf"lower(regexp_extract({_path(url)}, '\.([^./]+)$', 1))"
    let = " or ".join(f"starts_with(lower(url_decode({url})), '{p}')" for p in ALLOWED_PREFIXES)
    return f"""case when coalesce(trim({url}), '') = '' then 'empty' when {let} then null {rules} when {extension} in ({skipped}) then 'file type' when {extension} = 'doc' then 'legacy document'
        when lower(regexp_extract({url}, {_RE}, 2)) not in ('http', 'https') then 'no web address' end"""


_CLASS = "case when {0} is null then 'retry' when {0} = 304 then 'unchanged' when {0} between 200 and 299 then 'ok' when {0} >= 500 or {0} in (403, 408, 429) then 'retry' when {0} in (404, 410) then 'excluded' when {0} between 400 and 499 then 'client' else 'other' end"
_ROBOTS = ", ".join(f"('{h}', '{p}', {a})" for h, p, a in ROBOTS)
SQL = {
    "url_gate": f"select coalesce({_sql_reason('target_url')}, 'kept') as reason, count(*) as links, count(distinct target_url) as urls from links group by 1",
    "pending_frontier": _M + "select id, url, depth, row_number() over (order by depth, id) as place from m where crawl_status = 'pending'",
    "pages_by_url_list": _M + "select id, url from m where crawl_status = 'crawled' and url in (select target_url from links where is_document = 1)",
    "status_classes": f"select http_status, {_CLASS.format('http_status')} as class, coalesce(http_status between 400 and 499 and http_status not in (408, 429), false) as repeats, coalesce(http_status in (404, 410, 403, 500, 502, 503), false) as excluded, count(*) as n from pages group by http_status",
    "crawl_gates": _M + f""", g as (select *, {_sql_reason('url')} as reason, {_CLASS.format('http_status')} as c, lower(regexp_extract(url, {_RE}, 4)) as host from m),
        s as (select crawl_status, case when reason is not null then 'excluded' when depth > 4 then 'skipped' when host like 'mcg.%' then 'excluded' when c = 'excluded' then 'excluded' when c = 'retry' then 'failed'
              when host not like '%{INTERNAL}%' then 'excluded' else 'crawled' end as s from g)
        select crawl_status, case when crawl_status = 'crawled' then 'crawled' else s end as new_status, count(*) as n from s group by 1, 2""",
    "retroactive_exclusion": _M + f"select id, reason from (select id, {_sql_reason('url')} as reason from m where crawl_status in ('crawled', 'failed')) where reason is not null",
    "crawl_sweep": _M + """, f as (select distinct case when length(source_url) % 7 = 0 then upper(source_url) else source_url end as url from chunks where source_url is not null)
        select id, case when lower(url) in (select lower(url) from f) then 'case duplicate' else 'orphan' end as verdict from m where crawl_status = 'crawled' and url not in (select url from f)""",
    "status_merge": _M + "select crawl_status, case when crawl_status = 'crawled' then crawl_status when id % 3 = 0 then 'failed' when id % 3 = 1 then 'crawled' else crawl_status end as merged, count(*) as n from m group by 1, 2",
    "robots_states": f"""select host, case when ok > 0 then 'rules' when no > 0 then 'allow' when n >= 3 then 'abort' else 'retry' end as state from (
        select regexp_extract(url, {_RE}, 4) as host, count(*) filter (http_status between 200 and 299) as ok, count(*) filter (http_status between 400 and 499) as no, count(*) as n from pages where depth >= 5 group by 1)""",
    "robots_barred": _M + f""", r(rhost, prefix, allow) as (values {_ROBOTS}), u as (select id, regexp_extract(url, {_RE}, 4) as host, {_path('url')} as path from m),
        b as (select id, host, allow, row_number() over (partition by id order by length(prefix) desc nulls last, allow desc) as k from u left join r on host = rhost and starts_with(path, prefix))
        select host, coalesce(not allow, false) as barred, count(*) as n from b where k = 1 group by 1, 2""",
    "document_probe": _M + rf""", p as (select id, list_transform(list_filter(string_split({_path('url')}, '/'), lambda x: x <> ''), lambda x: regexp_replace(url_decode(x), '[-_]+', ' ', 'g')) as p from m where content_type <> 'html')
        select id, regexp_replace(p[-1], '\.[^.]*$', '') as title, array_to_string(p[:-2], '/') as above from p""",
    "cache_revalidation": _M + """, q as (select id, url, run, id % 4 <> 0 as have, id % 4 > 1 as tagged, case when id % 3 = 0 then 304 when id % 3 = 1 then 200 when run = 2 then 503 end as s from m cross join (values (1), (2)) r(run) where url is not null),
        o as (select run, case when not have then (case when s = 200 then 'fetched' else 'missing' end) when not tagged then 'trusted' when s = 304 then 'kept' when s = 200 then 'replaced' else 'stale' end as outcome, have from q)
        select run, outcome, case when outcome in ('fetched', 'replaced') then 2 when have then 1 end as version, count(*) as n from o group by 1, 2, 3""",
    "cache_entries": _M + "select sha256(url) as key from m where url is not null and content_hash <> ''",
    "run_lifecycle": _M + """, t as (select count(*) as d, count(*) filter (crawl_status = 'crawled') as c, count(*) filter (crawl_status = 'failed') as f, count(*) filter (crawl_status = 'excluded') as e from m),
        r as (select *, id = 3 and completed_at is null as mine from crawl_runs)
        select id, case when mine then timestamp '2026-01-01' else completed_at end as completed_at, case when mine then d else total_discovered end::int as total_discovered, case when mine then c else total_crawled end::int as total_crawled,
               case when mine then f else total_failed end::int as total_failed, case when mine then e else total_excluded end::int as total_excluded from r cross join t""",
    "status_and_hash_updates": _M + """select id, case when id % 10 = 0 then 'excluded' else crawl_status end as crawl_status, case when id % 10 = 0 then 'by hand' else exclusion_reason end as exclusion_reason,
        case when content_type <> 'html' and id % 2 = 0 then sha256(url) else content_hash end as content_hash from (select * from (select *, row_number() over (partition by id order by crawled_at desc nulls last, url desc nulls last,
        content_type desc nulls last, page_classification desc nulls last, chunking_strategy desc nulls last, crawl_status desc nulls last, content_hash desc nulls last, previous_content_hash desc nulls last, word_count desc nulls last,
        depth desc nulls last, exclusion_reason desc nulls last, http_status desc nulls last) as kk from pages where id is not null) where kk = 1)""",
    "manifest_lookup": _M + "select m.url is not null as there, crawl_status, case when m.url is not null then content_hash is not null end as hashed, count(*) as n from (select distinct target_url from links where target_url is not null) l left join m on m.url = l.target_url group by 1, 2, 3",
    "first_casing_urls": """with l as (select id, case when id % 5 = 0 then upper(target_url) else target_url end as url from links where target_url is not null), f as (select lower(url) as low, arg_min(url, id) as first from l group by 1)
        select url, count(*) as n from l join f on lower(url) = low and url = first group by url""",
}
