"""Queries of the chunkers and text functions, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import chunking as C
from tidemark.plans.materialize import spread
from tidemark.sources.tables import table


def word_count_stats(spark: SparkSession, d: str) -> DataFrame:
    n = T.word_count(F.col("text"))
    rows = table(spark, d, "documents").select("source", n.alias("n"))
    return rows.groupBy("source").agg(F.count("*").alias("docs"), F.sum("n").alias("words"), F.max("n").alias("most"), F.round(F.avg("n"), 4).alias("mean"))


def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", T.sentences(F.col("text")).alias("s"))
    return rows.select("doc_id", F.posexplode("s").alias("pos", "sentence")).select("doc_id", "pos", F.md5("sentence").alias("digest"), F.length("sentence").alias("n_chars"))


def semantic_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = C.semantic(spread(table(spark, d, "documents").select("doc_id", "text"), "doc_id"), "text").drop("text")
    out = C.numbered(rows, "pieces", F.array(F.lit("documents"), F.col("doc_id").cast("string")))
    return out.select("doc_id", "chunk_index", "chunk_total", "chunk_id", "word_count", "n_chars")


def semantic_chunks_english(spark: SparkSession, d: str) -> DataFrame:
    rows = C.semantic(spread(table(spark, d, "documents").select("doc_id", "text"), "doc_id"), "text").drop("text")
    out = C.numbered(rows, "pieces", F.array(F.lit("documents"), F.col("doc_id").cast("string")), english_only=True)
    return out.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum("word_count").alias("words"))


def simple_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = C.paragraphs(spread(table(spark, d, "documents").select("doc_id", "text"), "doc_id"), "text").drop("text")
    return C.numbered(rows, "pieces", F.array(F.lit("documents")), least=0).select("doc_id", "chunk_index", "chunk_total", "word_count", "n_chars", F.md5("chunk_text").alias("digest"))


def single_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Each text as one piece, those over the limits in the pieces that the limits make of them."""
    rows = C.semantic(spread(table(spark, d, "documents").select("doc_id", "text"), "doc_id"), "text").select("doc_id", F.posexplode("pieces").alias("place", "t"))
    return rows.filter("t <> ''").select("doc_id", "place", F.md5("t").alias("digest"), T.word_count(F.col("t")).alias("word_count"))


def row_groups(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat_ws(" | ", F.concat(F.lit("part: "), F.col("l_partkey").cast("string")), F.concat(F.lit("flag: "), "l_returnflag"), F.concat(F.lit("status: "), "l_linestatus"), F.concat(F.lit("line: "), F.col("l_linenumber").cast("string")))
    rows = table(spark, d, "lineitem").withColumn("key", F.floor(F.col("l_orderkey") / 8)).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", line.alias("r")))).alias("rs"))
    grouped = C.row_groups(rows.select("key", F.transform("rs", lambda r: r["r"]).alias("r")), "r", "g")
    return grouped.select("key", F.posexplode("g").alias("grp", "rows")).select("key", "grp", F.size("rows").alias("n_rows"), F.length(F.array_join("rows", "\n")).alias("n_chars"))


def chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chunks").filter(F.col("text").isNotNull())
    h = F.coalesce("section_hierarchy", F.array().cast("array<string>"))
    return rows.select("chunk_id", T.content_id(F.col("text"), h, F.col("chunk_index")).alias("content_id")).distinct()


def min_body_filter(spark: SparkSession, d: str) -> DataFrame:
    n = F.length(F.trim(T.body(F.col("text"))))
    return table(spark, d, "chunks").select("chunk_id", n.alias("n")).filter("n < 50").distinct().select("chunk_id", "n")


def context_header(spark: SparkSession, d: str) -> DataFrame:
    leaf = F.element_at("section_hierarchy", -1)
    rows = table(spark, d, "chunks").filter(F.size("section_hierarchy") > 0)
    shown = C.captioned(F.col("title"), leaf, F.col("text"))
    return rows.select("chunk_id", F.substring_index(shown, "\n", 1).alias("first_line")).distinct()


def language_flags(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return spread(table(spark, d, "documents").filter(t.isNotNull()).select("doc_id", "text"), "doc_id").select("doc_id", F.round(T.foreign_share(t), 6).alias("foreign_share"), T.is_spanish(t).alias("spanish"), T.is_foreign(t).alias("no_english"))


def sheet_guardrail(spark: SparkSession, d: str) -> DataFrame:
    """Sheets (suppliers of lineitem) with at most 200 rows give their rows, larger ones none."""
    rows = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("raw_rows"))
    return rows.select("l_suppkey", "raw_rows", F.when(F.col("raw_rows") > 200, 0).otherwise(F.col("raw_rows")).alias("kept_rows"))


def prose_row_containment(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of an odd index of which over 80 % of the words occur in the chunks of an even index of their page, taken for its rows.

    Words are rows that meet a page's distinct words by page and word, so that a page with very many chunks is spread by its words.
    """
    rows = table(spark, d, "chunks").filter(F.col("text").isNotNull() & F.col("source_url").isNotNull()).select("chunk_id", "source_url", "chunk_index", "text").distinct()
    words = rows.select("chunk_id", "source_url", (F.col("chunk_index") % 2 == 0).alias("even"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))).alias("w"))
    has = words.filter("even").select("source_url", "w").distinct().withColumn("there", F.lit(1))
    mine = words.filter("not even").groupBy("chunk_id", "source_url", "w").agg(F.count("*").alias("n"))
    sums = mine.join(has, ["source_url", "w"], "left").groupBy("chunk_id").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.coalesce("there", F.lit(0))).alias("inside"))
    return sums.filter("inside > 0.8 * n").select("chunk_id")


QUERIES = {
    f.__name__: f
    for f in (word_count_stats, sentence_split, semantic_chunks, semantic_chunks_english, simple_chunks, single_chunks, row_groups, chunk_ids, min_body_filter, context_header, language_flags, sheet_guardrail, prose_row_containment)
}

_WS = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def _squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_WS}', ' ', 'g'), ' ')"


def _count(x: str) -> str:
    return f"len(list_filter(string_split({_squeeze(x)}, ' '), lambda w: w <> ''))"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}|{_WS}$', '', 'g')"


def _hex(text: str, path: str, index: str) -> str:
    return f"substr(sha256({text} || chr(0) || {path} || chr(0) || {index}), 1, 32)"


_SENT = r"list_filter(string_split(regexp_replace(" + _squeeze("text") + r", '([.!?]) ([A-Z])', '\1' || chr(30) || '\2', 'g'), chr(30)), lambda s: length(s) > 2)"
_BODY = "case when text like '[%' and rtrim(string_split(text, chr(10))[1]) like '%]' then case when instr(text, chr(10)) > 0 then substr(text, instr(text, chr(10)) + 1) else '' end else text end"
_SPANISH = ", ".join(f"'{w}'" for w in T.SPANISH)
_ENGLISH = ", ".join(f"'{w}'" for w in T.ENGLISH)


def _lang(rows: str) -> str:
    return rf"""
        select *, len(list_filter(w, lambda x: x in ({_SPANISH}))) as es, len(list_filter(w, lambda x: x in ({_ENGLISH}))) as en, len(w) as n, length(l) as nl, length(regexp_replace(l, '[\x{{0}}-\x{{24F}}]', '', 'g')) as nf
        from (select *, regexp_extract_all(lower(text), '[a-záéíóúüñ]+') as w, regexp_replace(text, '[^\p{{L}}]', '', 'g') as l from {rows})
    """


_IS_ES = "(n >= 30 and es / nullif(n, 0) >= 0.20 and en / nullif(n, 0) < 0.05)"
_PACK = rf"""
    with recursive d as (select doc_id, text, {_SENT} as s from documents where text is not null),
    piece as (
        select doc_id, unnest(range(len(s)))::int as i, unnest(s) as s from d),
    cap as (
        select doc_id, i, k, case when n <= 500 and length(s) <= 20000 then s else list_aggregate(list_slice(w, k * 500 + 1, k * 500 + 500), 'string_agg', ' ') end as s
        from (select *, unnest(case when n <= 500 and length(s) <= 20000 then [0] else range(ceil(n / 500.0)::int) end) as k
              from (select *, list_filter(string_split(s, ' '), lambda x: x <> '') as w, len(list_filter(string_split(s, ' '), lambda x: x <> '')) as n from piece))),
    cap2 as (
        select doc_id, i, k, m, substr(s, m * 20000 + 1, 20000) as s from (select *, unnest(range(greatest(1, ceil(length(s) / 20000.0)::int))) as m from cap)),
    sent as (
        select doc_id, row_number() over (partition by doc_id order by i, k, m) - 1 as i, s, len(list_filter(string_split(s, ' '), lambda x: x <> '')) as n from cap2),
    run as (select doc_id, i, s, n, sum(n) over (partition by doc_id order by i) - n as before, count(*) over (partition by doc_id) as c, sum(n) over (partition by doc_id) as total from sent),
    fold as (
        select doc_id, 0::bigint as i, 0::bigint as start, n::bigint as size, null::bigint as ca, null::bigint as cb from run where i = 0
        union all
        select f.doc_id, r.i, case when f.size + r.n > 300 then coalesce(o.s, r.i) else f.start end,
               case when f.size + r.n > 300 then r.before - coalesce(o.b, r.before) + r.n else f.size + r.n end,
               case when f.size + r.n > 300 then f.start end, case when f.size + r.n > 300 then r.i end
        from fold f join run r on r.doc_id = f.doc_id and r.i = f.i + 1
        left join lateral (select min(q.i) as s, max(r.before - q.before) as w, r.before - max(r.before - q.before) as b from run q
                           where q.doc_id = f.doc_id and q.i >= f.start and q.i < r.i and r.before - q.before <= 60) o on true),
    ends as (
        select doc_id, ca as a, cb as b from fold where ca is not null
        union all select doc_id, start, i + 1 from fold join (select distinct doc_id, c from run) using (doc_id) where i = c - 1),
    long as (select e.doc_id, e.a, string_agg(r.s, ' ' order by r.i) as t from ends e join run r on r.doc_id = e.doc_id and r.i >= e.a and r.i < e.b group by e.doc_id, e.a, e.b),
    one as (select distinct d.doc_id from d join run using (doc_id) where total <= 500 and length(text) <= 20000),
    pieces as (
        select doc_id, 0 as a, 0 as m, {_strip("text")} as t from d semi join one using (doc_id)
        union all
        select doc_id, a, m, substr(t, m * 20000 + 1, 20000) as t from (select *, unnest(range(greatest(1, ceil(length(t) / 20000.0)::int))) as m from long anti join one using (doc_id))),
    kept as (
        select doc_id, a, m, t as text from pieces where length({_strip("(" + _BODY.replace("text", "t") + ")")}) >= 50)
"""
SQL = {
    "word_count_stats": f"select source, count(*) as docs, sum(n)::bigint as words, max(n)::int as most, round(avg(n), 4) as mean from (select source, {_count('text')} as n from documents) group by source",
    "sentence_split": f"select doc_id, unnest(range(len(s)))::int as pos, unnest(list_transform(s, lambda x: md5(x))) as digest, unnest(list_transform(s, lambda x: length(x)))::int as n_chars from (select doc_id, {_SENT} as s from documents where text is not null)",
    "semantic_chunks": _PACK + f""" select doc_id, (row_number() over w - 1)::int as chunk_index, (count(*) over (partition by doc_id))::int as chunk_total,
        {_hex(_squeeze('text'), "'documents/' || doc_id", "(row_number() over w - 1)")} as chunk_id, {_count('text')}::int as word_count, length(text)::int as n_chars from kept window w as (partition by doc_id order by a, m)""",
    "semantic_chunks_english": _PACK + f", lang as ({_lang('kept')}) select doc_id, count(*) as chunks, sum({_count('text')})::bigint as words from lang where not ((nf >= 15 and nf / nl > 0.10) or {_IS_ES}) group by doc_id",
    "single_chunks": _PACK + f" select doc_id, (row_number() over (partition by doc_id order by a, m) - 1)::int as place, md5(t) as digest, {_count('t')}::int as word_count from pieces where t <> ''",
    "simple_chunks": rf"""
        with recursive d as (select doc_id, text, list_filter(list_transform(string_split(regexp_replace(text, '\n+', chr(10), 'g'), chr(10)), lambda p: {_strip('p')}), lambda p: p <> '') as s from documents where text is not null),
        run as (select doc_id, i, s, {_count('s')} as n, c, sum({_count('s')}) over (partition by doc_id) as total from (select doc_id, unnest(range(len(s)))::bigint as i, unnest(s) as s, len(s) as c from d)),
        fold as (
            select doc_id, i, 0::bigint as g, n::bigint as size from run where i = 0
            union all select f.doc_id, r.i, case when f.size + r.n > 250 then f.g + 1 else f.g end, case when f.size + r.n > 250 then r.n else f.size + r.n end from fold f join run r on r.doc_id = f.doc_id and r.i = f.i + 1),
        grp as (select doc_id, g, sum(n) as n, max(g) over (partition by doc_id) as last from fold join run using (doc_id, i) group by doc_id, g),
        final as (select f.doc_id, f.i, case when f.g > 0 and f.g = grp.last and grp.n < 30 then f.g - 1 else f.g end as g from fold f join grp using (doc_id, g)),
        piece as (
            select doc_id, g, string_agg(s, chr(10) || chr(10) order by i) as t from final join run using (doc_id, i) where total > 250 group by doc_id, g
            union all select doc_id, 0, {_strip('text')} from d where doc_id in (select doc_id from run where total <= 250))
        select doc_id, (row_number() over (partition by doc_id order by g) - 1)::int as chunk_index, (count(*) over (partition by doc_id))::int as chunk_total, {_count('t')}::int as word_count, length(t)::int as n_chars, md5(t) as digest from piece""",
    "row_groups": """
        with recursive r as (
            select l_orderkey // 8 as key, row_number() over (partition by l_orderkey // 8 order by l_orderkey, l_linenumber, 'part: ' || l_partkey || ' | flag: ' || l_returnflag || ' | status: ' || l_linestatus || ' | line: ' || l_linenumber) as i,
                   length('part: ' || l_partkey || ' | flag: ' || l_returnflag || ' | status: ' || l_linestatus || ' | line: ' || l_linenumber) as n from lineitem),
        f as (
            select key, i, n, 0 as g, n + 1 as size from r where i = 1
            union all select r.key, r.i, r.n, case when f.size + r.n > 1000 and f.size >= 200 then f.g + 1 else f.g end, case when f.size + r.n > 1000 and f.size >= 200 then r.n + 1 else f.size + r.n + 1 end
            from f join r on r.key = f.key and r.i = f.i + 1)
        select key, g::int as grp, count(*)::int as n_rows, (sum(n) + count(*) - 1)::int as n_chars from f group by key, g""",
    "chunk_ids": f"select distinct chunk_id, {_hex(_squeeze('text'), 'coalesce(array_to_string(section_hierarchy, ' + chr(39) + '/' + chr(39) + '), ' + chr(39) * 2 + ')', 'chunk_index')} as content_id from chunks where text is not null",
    "min_body_filter": f"select distinct chunk_id, n::int as n from (select chunk_id, length(trim({_BODY}, ' ')) as n from chunks) where n < 50",
    "context_header": rf"""
        with c as (select chunk_id, title, text, {_strip('title')} as st, lower({_strip('title')}) as nm, lower({_strip('text')}) as lo, section_hierarchy[len(section_hierarchy)] as leaf from chunks where len(section_hierarchy) > 0)
        select distinct chunk_id, string_split(case when title is null or st = '' or text is null or lo = '' or lo like '[%' or (starts_with(lo, nm) and not regexp_matches(substr(lo, length(nm) + 1, 1), '^[\p{{L}}\p{{N}}_]')) then text
            else '[' || st || case when coalesce(leaf, '') <> '' and not regexp_matches(leaf, '(?i)\.(pdf|docx?|xlsx?|csv|html?)$') and lower(leaf) <> nm then ' — ' || leaf else '' end || ']' end, chr(10))[1] as first_line from c""",
    "language_flags": f"select doc_id, round(coalesce(nf / nullif(nl, 0), 0.0), 6) as foreign_share, {_IS_ES} as spanish, ((nf >= 15 and coalesce(nf / nullif(nl, 0), 0) > 0.10) or {_IS_ES}) as no_english from ({_lang('(select doc_id, text from documents where text is not null)')})",
    "sheet_guardrail": "select l_suppkey, count(*) as raw_rows, case when count(*) > 200 then 0 else count(*) end as kept_rows from lineitem group by l_suppkey",
    "prose_row_containment": """
        with c as (select distinct chunk_id, source_url, chunk_index, regexp_extract_all(lower(text), '[a-z0-9]+') as w from chunks where text is not null and source_url is not null),
        e as (select distinct source_url, unnest(w) as w from c where chunk_index % 2 = 0), o as (select chunk_id, source_url, unnest(w) as w from c where chunk_index % 2 <> 0)
        select chunk_id from o left join e using (source_url, w) group by chunk_id having count(e.source_url) > 0.8 * count(*)""",
}
