"""Queries of routing and upkeep, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions import urls as U
from tidemark.operators import classify, routing, upkeep
from tidemark.operators.chunking_queries import _count, _strip
from tidemark.operators.corpus_queries import _M, _RE, _url_set, manifest
from tidemark.sources.tables import table

_MIME = ["application/pdf", "TEXT/HTML; charset=utf-8", "text/csv", "application/octet-stream", None]


def payload_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Links by the payload that their content type (by id) and extension name."""
    extension = F.regexp_extract(U.part(F.col("target_url"), "path"), r"\.([^./]+)$", 1)
    mime = F.element_at(F.array(*map(F.lit, _MIME)), (F.col("id") % len(_MIME) + 1).cast("int"))
    return table(spark, d, "links").groupBy(routing.payload_kind(mime, extension).alias("kind")).agg(F.count("*").alias("n"))


def text_cascade(spark: SparkSession, d: str) -> DataFrame:
    """The first usable of three extractions of each document: its first word, its first nineteen characters, its text."""
    t = F.col("text")
    text, place = routing.cascade(F.when(F.col("doc_id") % 3 == 0, F.substring(t, 1, 40)), F.substring(t, 1, 5), F.when(F.col("doc_id") % 2 == 0, t))
    return table(spark, d, "documents").select("doc_id", F.md5(text).alias("digest"), place.alias("place"))


def document_structures(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", routing.document_structure(F.col("text"), (F.col("doc_id") % 20 == 0).cast("int") * 2).alias("structure"))
    return rows.groupBy("structure").agg(F.count("*").alias("n"))


def effective_strategies(spark: SparkSession, d: str) -> DataFrame:
    """Chunks by their strategy and the one that their text leads to, with no pairs or rows found in every fourth."""
    s = routing.effective_strategy(U.content_type(F.coalesce("source_url", F.lit(""))), F.col("chunking_strategy"), F.col("chunk_index") % 4, F.col("text"))
    rows = table(spark, d, "chunks").select("chunk_id", "chunking_strategy", s.alias("effective")).distinct()
    return rows.groupBy("chunking_strategy", "effective").agg(F.count("*").alias("n"))


def page_results(spark: SparkSession, d: str) -> DataFrame:
    made = table(spark, d, "chunks").groupBy(F.col("source_url").alias("url")).agg(F.count_distinct("chunk_id").alias("n")).dropna()
    rows = manifest(spark, d).join(made, "url", "left")
    changed = F.col("previous_content_hash").isNull() | ~F.col("content_hash").eqNullSafe(F.col("previous_content_hash"))
    result = routing.page_result(F.coalesce("n", F.lit(0)), F.when(F.col("crawl_status") == "failed", "fetch"), changed)
    return rows.groupBy(result.alias("result")).agg(F.count("*").alias("pages"))


def banner_strip(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "pages").filter("extracted_snippet is not null").select("id", routing.without_banner(F.col("extracted_snippet"), ["skip to content", "home"]).alias("t"), "extracted_snippet")
    return rows.filter("t <> extracted_snippet").select("id", F.md5("t").alias("digest")).distinct()


def chunk_metadata(spark: SparkSession, d: str) -> DataFrame:
    pages = manifest(spark, d).select(F.col("url").alias("_url")).dropna().distinct()
    rows = table(spark, d, "chunks").join(pages, F.col("source_url") == F.col("_url"), "left_semi")
    m = routing.metadata(_url_set(), F.col("title"), F.col("section_hierarchy"), F.col("page_classification"), F.col("chunking_strategy"), {"question": F.col("question"), "text": F.col("text")}, ["question"])
    out = rows.select("chunk_id", m.alias("m")).distinct()
    return out.select("chunk_id", "m.source_url", F.array_join("m.source_urls", " ").alias("urls"), F.array_join("m.section_hierarchy", "/").alias("hierarchy"), "m.question")


def page_hierarchies(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("id", F.array_join(routing.hierarchy(F.col("section_hierarchy")), " > ").alias("levels")).distinct()


def answer_caps(spark: SparkSession, d: str) -> DataFrame:
    """Questions and their answers, whole texts of the chunk as answers, in pieces within the chunk limits."""
    rows = table(spark, d, "chunks").filter("question is not null and text is not null").select("chunk_id", "question", F.concat_ws("\n", "answer", "text").alias("answer")).distinct()
    cut = routing.capped_answers(rows, "question", "answer").select("chunk_id", F.posexplode("pieces").alias("place", "piece"))
    return cut.select("chunk_id", "place", F.startswith("piece", F.lit("Q: ")).alias("asked"), (F.length("piece") > 20_000).alias("long"))


def file_routing(spark: SparkSession, d: str) -> DataFrame:
    """Short documents as they come whole from a file; of the others how many pieces."""
    rows = routing.file_pieces(table(spark, d, "documents").select("doc_id", "text"), "text")
    short = T.word_count(T.stripped(F.coalesce("text", F.lit("")))) <= routing.WHOLE_FILE
    return rows.select("doc_id", short.alias("whole"), F.when(short, F.size("pieces")).otherwise(F.least(F.size("pieces"), F.lit(1))).alias("pieces"))


def hash_claims(spark: SparkSession, d: str) -> DataFrame:
    rows = manifest(spark, d).withColumn("h", F.lower(F.trim("content_hash"))).filter("h <> ''")
    skipped = F.coalesce("chunking_strategy", F.lit("")) == "skip"
    return routing.claims(rows, "id", "h", F.col("crawl_status") == "crawled", skipped).groupBy("first").agg(F.count("*").alias("pages"), F.min("id").alias("least"))


def table_columns(spark: SparkSession, d: str) -> DataFrame:
    """Whether a chunk's lines, cut at bars, have a row of two cells or more."""
    cells = F.transform(F.split("text", "\n"), lambda x: F.split(x, r"\|"))
    return table(spark, d, "chunks").filter("text is not null").select("chunk_id", routing.has_columns(cells).alias("table")).distinct().groupBy("table").agg(F.count("*").alias("n"))


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as text blocks of pages: a few across the page, others left or right."""
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("block"), F.col("l_quantity").alias("q"), F.lit(600.0).alias("width"))
    x0 = F.when(F.col("q") > 45, 20.0).when(F.col("block") % 2 == 0, 20.0).otherwise(320.0)
    x1 = F.when(F.col("q") > 45, 580.0).when(F.col("block") % 2 == 0, 280.0).otherwise(580.0)
    return rows.select("page", "block", x0.alias("x0"), x1.alias("x1"), (F.col("q") * 10).alias("y0"), (F.col("q") * 10 + 60).alias("y1"), "width")


def column_order(spark: SparkSession, d: str) -> DataFrame:
    return routing.reading_order(_blocks(spark, d)).select("page", "block", "two", "place")


def _listing(spark: SparkSession, d: str) -> DataFrame:
    """Folders of years and counties with documents in them, some with unsafe names."""
    docs = table(spark, d, "documents").select("doc_id", "source")
    years = spark.createDataFrame([(-1, 0, "2026-primary", True), (-2, 0, "2026-general", True), (-3, 0, "old", True), (-4, -1, "forms", True), (-5, -1, "..", True)], "id long, parent long, name string, folder boolean")
    name = F.when(F.col("doc_id") % 50 == 0, F.concat(F.lit("a/b"), F.col("doc_id").cast("string"))).otherwise(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".pdf")))
    return years.unionByName(docs.select(F.col("doc_id").alias("id"), (-(F.col("doc_id") % 5) - 1).alias("parent"), name.alias("name"), F.lit(False).alias("folder")))


def folder_walk(spark: SparkSession, d: str) -> DataFrame:
    return upkeep.walk(_listing(spark, d), 0, "2026-")


def folder_ids(spark: SparkSession, d: str) -> DataFrame:
    """The years that a document's text names, each once, in order."""
    rows = table(spark, d, "documents").filter("text is not null").select(F.col("doc_id").alias("page"), "text")
    return upkeep.folder_links(rows, "text", r"\b(20\d\d)\b")


def ingest_plan(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.concat(F.lit("k"), F.col("doc_id").cast("string")).alias("key"), "url", F.col("n_chars"))
    files = rows.filter("doc_id % 9 <> 0").select("key", upkeep.fingerprint(F.col("n_chars"), F.col("doc_id")).alias("mark"))
    state = rows.filter("doc_id % 4 <> 0").select("key", F.when(F.col("doc_id") % 5 == 0, "old").otherwise(upkeep.fingerprint(F.col("n_chars"), F.col("doc_id"))).alias("mark"))
    return upkeep.ingest_plan(files, rows.select("key", "url"), state).groupBy("plan").agg(F.count("*").alias("n"))


def local_drift(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.concat(F.lit("k"), F.col("doc_id").cast("string")).alias("key"))
    return upkeep.drifted(rows.filter("doc_id % 6 <> 0"), rows.filter("doc_id % 7 <> 0"))


def local_paths(spark: SparkSession, d: str) -> DataFrame:
    key = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("../"), "source")).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("/"), "source")).otherwise(F.concat_ws("/", "source", F.col("doc_id").cast("string")))
    return table(spark, d, "documents").filter("source is not null").select("doc_id", upkeep.local_path("/data/files/", key).alias("path"))


def intact_files(spark: SparkSession, d: str) -> DataFrame:
    content = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    announced = F.when(F.col("doc_id") % 3 == 0, F.upper(F.sha1(content))).otherwise(F.sha1(F.lit("x")))
    rows = table(spark, d, "documents").select(upkeep.intact(content, F.octet_length(content), announced).alias("intact"))
    return rows.groupBy("intact").agg(F.count("*").alias("n"))


def review_report(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat_ws("-", "lang", F.col("doc_id").cast("string"))
    rows = table(spark, d, "documents").filter("lang is not null").select(F.when(F.col("doc_id") % 3 == 0, "include").when(F.col("doc_id") % 3 == 1, "exclude").otherwise("review").alias("decision"), name.alias("name"))
    return upkeep.review_report(rows)


def _faults() -> dict:
    t = F.col("text")
    empty = t.isNull() | (T.stripped(F.coalesce(t, F.lit(""))) == "")
    return {"empty": empty, "short": ~empty & (F.length(t) < 50), "long": ~empty & (F.length(t) > 8000), "no source": F.col("source_url").isNull(), "none": ~empty & F.contains(t, F.lit("None: never"))}


def verify_gate(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chunks").select("chunk_id", "text", "source_url").distinct()
    mine = upkeep.checks(rows, _faults(), warnings=("short", "long"))
    return mine.unionByName(upkeep.checks(rows.limit(0), {"files": F.lit(True)}))


def offender_samples(spark: SparkSession, d: str) -> DataFrame:
    return upkeep.offenders(table(spark, d, "chunks").select("chunk_id", "text", "source_url"), _faults())


def web_and_files(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of pages and of documents as one table; documents have no index."""
    web = table(spark, d, "chunks").select("chunk_id", F.col("page_classification").alias("kind"), "chunk_index")
    files = table(spark, d, "documents").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("chunk_id"), F.lit("file").alias("kind"))
    return upkeep.all_chunks(web, files).groupBy("kind").agg(F.count("*").alias("n"), F.count("chunk_index").alias("indexed"))


def vector_store(spark: SparkSession, d: str) -> DataFrame:
    """Stored vectors by label after an upsert of every third, with a new label, some of another dimension."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    cut = F.when(F.col("id") % 9 == 0, F.slice("embedding", 1, 10)).otherwise(F.col("embedding"))
    new = rows.filter("id % 3 = 0").select("id", cut.alias("embedding"), F.lit(99).cast(rows.schema["label"].dataType).alias("label"))
    store, counts = upkeep.store_vectors(rows, new, 64)
    stored = store.groupBy(F.col("label").cast("string").alias("what")).agg(F.count("*").alias("n"))
    return stored.unionByName(counts.select(F.explode(F.array(F.struct(F.lit("stored").alias("what"), F.col("stored").alias("n")), F.struct(F.lit("failed").alias("what"), F.col("failed").alias("n")))).alias("x")).select("x.*"))


def reclassified_pages(spark: SparkSession, d: str) -> DataFrame:
    pages = manifest(spark, d)
    new = pages.select("id", F.when(F.col("id") % 8 == 0, "prose").otherwise(F.col("page_classification")).alias("page_classification"), F.when(F.col("id") % 12 == 0, "skip").otherwise(F.col("chunking_strategy")).alias("chunking_strategy"))
    return upkeep.reclassified(pages, new).select("id", "page_classification", "new_class", "chunking_strategy", "new_strategy")


def json_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of JSON from the events, some broken or blank: what is read, and the faults by file and line."""
    bad = F.when(F.col("event_id") % 10 == 0, "").when(F.col("event_id") % 10 == 1, F.concat(F.lit("{"), "props")).otherwise(F.col("props"))
    rows = table(spark, d, "events").select(F.concat(F.lit("f"), (F.col("event_id") % 3).cast("string")).alias("file"), F.col("event_id").alias("line_no"), bad.alias("value"))
    return upkeep.numbered_lines(rows, "k int").select("line_no", "row.k", "fault")


SIGNALS = classify.Signals(
    junk="/about/.*sample", link_index="/forms?/|index[.]html", faq="questions about", faq_path="/faq", press="press_room|for immediate release", location="/earlyvoting/", table="-results-", form="agent form|petition", banners=["skip to content", "home"],
)


def page_classes(spark: SparkSession, d: str) -> DataFrame:
    """Crawled page rows by class and strategy; every eleventh has the markup of an FAQ, every seventh a table of as many rows as its depth and three more."""
    rows = table(spark, d, "pages").filter("crawl_status = 'crawled'")
    kind = classify.page_class(
        F.col("url"), F.col("title"), F.col("extracted_snippet"), F.col("word_count"), F.col("content_type"), F.col("id") % 11 == 0, F.when(F.col("id") % 7 == 0, F.col("depth") + 3), SIGNALS
    )
    out = rows.select(kind.alias("page_class"), classify.strategy(kind, F.col("word_count")).alias("strategy"))
    return out.groupBy("page_class", "strategy").agg(F.count("*").alias("n"))


def audit_report(spark: SparkSession, d: str) -> DataFrame:
    """The counts of an audit as one table (section, name, n)."""
    pages = manifest(spark, d)
    names = {"class": "page_classification", "strategy": "chunking_strategy", "type": "content_type", "status": "crawl_status", "exclusion": "exclusion_reason", "depth": "depth"}
    each = pages.select(F.explode(F.array(*[F.struct(F.lit(k).alias("section"), F.coalesce(F.col(c).cast("string"), F.lit("none")).alias("name")) for k, c in names.items()])).alias("x"))
    return each.groupBy("x.section", "x.name").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        page_classes, audit_report, payload_kinds, text_cascade, document_structures, effective_strategies, page_results, banner_strip, chunk_metadata, page_hierarchies, answer_caps, file_routing, hash_claims, table_columns, column_order,
        folder_walk, folder_ids, ingest_plan, local_drift, local_paths, intact_files, review_report, verify_gate, offender_samples, web_and_files, vector_store, reclassified_pages, json_lines,
    )
}

_SIGNS = r"length(regexp_replace({0}, '[^\p{L}\p{M}\p{Nd}_\x{{200C}}\x{{200D}}]', '', 'g'))".replace("{L}", "{{L}}").replace("{M}", "{{M}}").replace("{Nd}", "{{Nd}}")
_BLANK = f"coalesce({_SIGNS.format('text')} < 20, true)"
_LINES = "len(list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> ''))"
_QUESTIONS = "(length(text) - length(replace(text, '?', '')))"


def _structure(tables: str) -> str:
    return f"case when {_BLANK} then 'empty' when {tables} >= 2 then 'tables' when {_QUESTIONS} >= 5 and {_QUESTIONS} / greatest({_LINES}, 1) > 0.05 then 'faq' when {_count('text')} < 150 then 'short' else 'prose' end"


_EXT = rf"lower(regexp_extract(regexp_extract({{0}}, {_RE}, 5), '\.([^./]+)$', 1))"
_FAULTS = {"empty": "e", "short": "not e and length(text) < 50", "long": "not e and length(text) > 8000", "no source": "source_url is null", "none": "not e and contains(text, 'None: never')"}
_FAULTY = f"(select distinct chunk_id, text, source_url, text is null or {_strip('text')} = '' as e from chunks)"
SQL = {
    "page_classes": """with p as (select *, lower(coalesce(url, '')) as u, lower(coalesce(title, '')) as t, coalesce(word_count, 0) as n, lower(coalesce(case when (starts_with(lower(extracted_snippet), 'skip to content') or starts_with(lower(extracted_snippet), 'home'))
            and contains(extracted_snippet, chr(10)) then ltrim(substr(extracted_snippet, instr(extracted_snippet, chr(10)) + 1), ' ') else extracted_snippet end, '')) as b, case when id % 7 = 0 then coalesce(depth, 0) + 3 else 0 end as r from pages where crawl_status = 'crawled'),
        c as (select *, case when content_type <> 'html' then 'document' when regexp_matches(u, '/about/.*sample') then 'junk' when regexp_matches(u, '/forms?/|index[.]html') then 'nav_hub' when contains(u || ' ' || t, 'questions about') or contains(u, '/faq') then 'faq'
            when regexp_matches(u || ' ' || t, 'press_room|for immediate release') or regexp_matches(substr(b, 1, 2000), 'press_room|for immediate release') then 'press_release' when contains(u, '/earlyvoting/') then 'location_list' when contains(u, '-results-') then 'table_data'
            when regexp_matches(u || ' ' || t, 'agent form|petition') then 'form' when n >= 500 then 'prose' when n < 150 and id % 11 <> 0 and r < 5 then 'short_static' when id % 11 = 0 then 'faq' when r >= 5 then 'table_data' else 'nav_hub' end as k from p)
        select k as page_class, case when n = 0 and k not in ('junk', 'document') then 'skip' else case k when 'junk' then 'skip' when 'faq' then 'qa_pairs' when 'press_release' then 'simple' when 'table_data' then 'table_rows' when 'form' then 'simple'
            when 'prose' then 'semantic' when 'document' then 'document' else 'single' end end as strategy, count(*) as n from c group by 1, 2""",
    "audit_report": _M.replace("from (select *, row_number()", "from (select *, row_number()").replace("word_count desc nulls last)", "word_count desc nulls last, depth desc nulls last, exclusion_reason desc nulls last, http_status desc nulls last)") + ", x as (" + " union all ".join(
        f"select '{k}' as section, coalesce({c}::varchar, 'none') as name from m" for k, c in {"class": "page_classification", "strategy": "chunking_strategy", "type": "content_type", "status": "crawl_status", "exclusion": "exclusion_reason", "depth": "depth"}.items()
    ) + ") select section, name, count(*) as n from x group by 1, 2",
    "payload_kinds": f"""with l as (select ['application/pdf', 'text/html', 'text/csv', 'application/octet-stream', null][id % 5 + 1] as m, {_EXT.format('target_url')} as e from links)
        select case m when 'application/pdf' then 'pdf' when 'text/html' then 'html' when 'text/csv' then 'csv' else case when e in ('pdf', 'doc', 'docx', 'xls', 'xlsx', 'csv', 'html', 'txt') then e when e = 'xlsm' then 'xlsx' when e = 'htm' then 'html' end end as kind, count(*) as n from l group by 1""",
    "text_cascade": f"""with c as (select doc_id, unnest([1, 2, 3]) as p, unnest([case when doc_id % 3 = 0 then substr(text, 1, 40) end, substr(text, 1, 5), case when doc_id % 2 = 0 then text end]) as text from documents),
        k as (select *, row_number() over (partition by doc_id order by {_BLANK}, p) as k from c where not {_BLANK} or {_strip("coalesce(text, '')")} <> '')
        select d.doc_id, md5(k.text) as digest, p as place from documents d left join k on k.doc_id = d.doc_id and k = 1""",
    "document_structures": f"select {_structure('(case when doc_id % 20 = 0 then 2 else 0 end)')} as structure, count(*) as n from documents group by 1",
    "effective_strategies": f"""with c as (select distinct chunk_id, chunking_strategy, chunk_index % 4 as f, text, case when {_EXT.format("coalesce(source_url, '')")} in ('pdf', 'docx', 'doc', 'xls', 'xlsx', 'csv') then {_EXT.format("coalesce(source_url, '')")} else 'html' end as k from chunks),
        s as (select *, {_structure('0')} as s from c)
        select chunking_strategy, case when chunking_strategy = 'skip' then 'skip' when k = 'doc' then 'none' when k in ('xlsx', 'xls', 'csv') then 'sheet_rows'
            when k in ('pdf', 'docx') then case s when 'empty' then 'none' when 'short' then 'single' when 'faq' then 'paragraphs' else 'semantic' end
            when chunking_strategy in ('qa_pairs', 'table_rows') and f = 0 then 'simple_split' else coalesce(chunking_strategy, 'simple_split') end as effective, count(*) as n from s group by 1, 2""",
    "page_results": _M + """, c as (select source_url, count(distinct chunk_id) as n from chunks where source_url is not null group by 1)
        select case when not (previous_content_hash is null or content_hash is distinct from previous_content_hash) then 'unchanged' when crawl_status = 'failed' then 'failed' when coalesce(n, 0) > 0 then 'success' else 'deliberate zero' end as result, count(*) as pages
        from m left join c on c.source_url = m.url group by 1""",
    "banner_strip": """with p as (select id, extracted_snippet as s, case when (starts_with(lower(extracted_snippet), 'skip to content') or starts_with(lower(extracted_snippet), 'home')) and contains(extracted_snippet, chr(10))
        then ltrim(substr(extracted_snippet, instr(extracted_snippet, chr(10)) + 1), ' ') else extracted_snippet end as t from pages where extracted_snippet is not null) select distinct id, md5(t) as digest from p where t <> s""",
    "chunk_metadata": _M + """, c as (select *, list_concat([source_url], list_filter(coalesce(source_urls, []), lambda u: u is not null and u <> source_url)) as u from chunks where source_url in (select url from m where url is not null))
        select distinct chunk_id, source_url, array_to_string(u, ' ') as urls, array_to_string(section_hierarchy, '/') as hierarchy, question from c""",
    "file_routing": f"""with t as (select doc_id, {_strip("coalesce(text, '')")} as t from documents)
        select doc_id, {_count('t')} <= 150 as whole, case when {_count('t')} <= 150 then (length(trim(t, ' ')) >= 50)::int else 1 end as pieces from t""",
    "page_hierarchies": "select distinct id, coalesce(array_to_string(case when trim(section_hierarchy) <> '' then from_json(section_hierarchy, '[\"varchar\"]') end, ' > '), '') as levels from pages",
    "folder_walk": """with l as (select doc_id as id, -(doc_id % 5) - 1 as p, case when doc_id % 50 = 0 then null else 'd' || doc_id || '.pdf' end as n from documents)
        select id, case p when -1 then '2026-primary/' when -2 then '2026-general/' when -4 then '2026-primary/forms/' end || n as key, case p when -4 then 3 else 2 end as depth from l where n is not null and p in (-1, -2, -4)""",
    "folder_ids": r"""with i as (select doc_id as page, unnest(regexp_extract_all(text, '\b(20\d\d)\b', 1)) as id, unnest(range(len(regexp_extract_all(text, '\b(20\d\d)\b', 1)))) as p from documents where text is not null),
        f as (select page, id, min(p) as p from i group by 1, 2) select page, id, row_number() over (partition by page order by p)::int as place from f""",
    "ingest_plan": """with r as (select doc_id, concat_ws(':', n_chars, doc_id) as mark, coalesce(trim(url), '') as url from documents), f as (select * from r where doc_id % 9 <> 0), s as (select doc_id, case when doc_id % 5 = 0 then 'old' else mark end as was from r where doc_id % 4 <> 0)
        select case when f.doc_id is null then 'stale' when f.url = '' then 'skipped' when s.doc_id is null then 'new' when f.mark = s.was then 'unchanged' else 'changed' end as plan, count(*) as n from f full join s on s.doc_id = f.doc_id group by 1""",
    "local_drift": "select 'k' || doc_id as key, case when doc_id % 7 = 0 then 'not here' else 'not listed' end as drift from documents where (doc_id % 6 = 0) <> (doc_id % 7 = 0)",
    "local_paths": "select doc_id, case when doc_id % 4 in (0, 1) or trim(source, ' ') = '' then null else '/data/files/' || source || '/' || doc_id end as path from documents where source is not null",
    "intact_files": "select doc_id % 3 = 0 as intact, count(*) as n from documents group by 1",
    "review_report": """with r as (select case doc_id % 3 when 0 then 'include' when 1 then 'exclude' else 'review' end as d, lang || '-' || doc_id as n from documents where lang is not null),
        l as (select d, '' as n, d || ' (' || count(*) || ')' as line from r group by d union all select d, n, '  ' || n from r) select row_number() over (order by d, n) as place, line from l""",
    "verify_gate": "select c.c as \"check\", case when n = 0 then 'PASS' when c.c in ('short', 'long') then 'WARN' else 'FAIL' end as status, n from (" + " union all ".join(f"select '{k}' as c, count(*) filter ({v}) as n from {_FAULTY}" for k, v in _FAULTS.items()) + ") c union all select 'files', 'SKIPPED', 0",
    "offender_samples": "with h as (" + " union ".join(f"select '{k}' as c, chunk_id from {_FAULTY} where {v}" for k, v in _FAULTS.items()) + """), r as (select *, row_number() over (partition by c order by chunk_id) as k, count(*) over (partition by c) as n from h)
        select c as "check", string_agg(chunk_id, ' ' order by chunk_id) as sample, max(n) - count(*) as more from r where k <= 10 group by c""",
    "web_and_files": "select page_classification as kind, count(*) as n, count(chunk_index) as indexed from chunks group by 1 union all select 'file', count(*), 0 from documents",
    "vector_store": """with e as (select *, vec_id % 3 = 0 and vec_id % 9 <> 0 as good from embeddings)
        select case when good then '99' else label::varchar end as what, count(*) as n from e group by 1 union all select 'stored', count(*) filter (good) from e union all select 'failed', count(*) filter (vec_id % 9 = 0) from e""",
    "reclassified_pages": _M + """, n as (select id, page_classification, case when id % 8 = 0 then 'prose' else page_classification end as new_class, chunking_strategy, case when id % 12 = 0 then 'skip' else chunking_strategy end as new_strategy from m)
        select * from n where page_classification is distinct from new_class or chunking_strategy is distinct from new_strategy""",
    "json_lines": "select event_id as line_no, case when event_id % 10 <> 1 then (props->>'k')::int end as k, case when event_id % 10 = 1 then 'f' || event_id % 3 || ':' || event_id end as fault from events where event_id % 10 <> 0",
    "hash_claims": _M + """, h as (select id, lower(trim(content_hash)) as h, crawl_status = 'crawled' and coalesce(chunking_strategy, '') <> 'skip' as ok from m where trim(content_hash) <> ''), f as (select h, min(id) filter (ok) as first from h group by 1)
        select first, count(*) as pages, min(id) as least from h join f using (h) group by first""",
    "table_columns": "select len(list_filter(string_split(text, chr(10)), lambda r: len(list_filter(string_split(r, '|'), lambda c: trim(c) <> '')) >= 2)) > 0 as \"table\", count(*) as n from (select distinct chunk_id, text from chunks where text is not null) group by 1",
    "column_order": """with b as (select l_orderkey as page, l_linenumber as block, l_quantity * 10 as y0, l_quantity * 10 + 60 as y1, case when l_quantity > 45 then 0 when l_linenumber % 2 = 0 then 1 else 2 end as s from lineitem),
        t as (select page, coalesce(count(*) filter (s = 1) >= 2 and count(*) filter (s = 2) >= 2 and min(y0) filter (s = 1) < max(y1) filter (s = 2) and min(y0) filter (s = 2) < max(y1) filter (s = 1), false) as two from b group by page),
        r as (select *, case when s = 2 then 320.0 else 20.0 end as x0, two and s = 0 as a from b join t using (page)),
        n as (select *, case when two then 2 * sum(a::int) over (partition by page order by y0, x0, block rows unbounded preceding) - a::int else 0 end as band, case when two and s = 2 then 1 else 0 end as col from r)
        select page, block, two, row_number() over (partition by page order by band, col, y0, x0, block)::int as place from n""",
}
