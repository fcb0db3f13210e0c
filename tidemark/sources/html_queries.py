"""Queries of the HTML readers over pages that are put together from the tables, with SQL over the tables themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.sources import files, html
from tidemark.sources.tables import table


def _escaped(c: Column) -> Column:
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(raw), F.lit(name))
    return c


def faq_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chunks").select("source_url", "question", "answer").dropna().filter("trim(question) <> '' and trim(answer) <> ''").distinct()
    item = F.concat(F.lit("<dt>"), _escaped(F.col("question")), F.lit("</dt><dd>"), _escaped(F.col("answer")), F.lit("</dd>"))
    pages = rows.groupBy("source_url").agg(F.concat(F.lit("<title>x</title><dl>"), F.array_join(F.array_sort(F.collect_list(item)), ""), F.lit("</dl>")).alias("html"))
    found = html.read_pages(pages, "source_url").select("source_url", F.explode("pairs").alias("p"))
    return found.groupBy("source_url").agg(F.count("*").alias("pairs"), F.sum(T.word_count(F.col("p.question")) + T.word_count(F.col("p.answer"))).alias("words"))


def _pairs_page(spark: SparkSession, d: str, item: Column) -> DataFrame:
    """Pairs found in pages whose questions and answers stand in the given markup."""
    rows = table(spark, d, "chunks").select("source_url", "question", "answer").dropna().filter("trim(question) <> '' and trim(answer) <> ''").distinct()
    pages = rows.groupBy("source_url").agg(F.concat(F.lit("<title>x</title><main>"), F.array_join(F.array_sort(F.collect_list(item)), ""), F.lit("</main>")).alias("html"))
    found = html.read_pages(pages, "source_url").select("source_url", F.explode("pairs").alias("p"))
    return found.groupBy("source_url").agg(F.count("*").alias("pairs"), F.sum(T.word_count(F.col("p.question")) + T.word_count(F.col("p.answer"))).alias("words"))


def details_pairs(spark: SparkSession, d: str) -> DataFrame:
    q, a = _escaped(F.col("question")), _escaped(F.col("answer"))
    return _pairs_page(spark, d, F.concat(F.lit("<details><summary>"), q, F.lit("</summary><p>"), a, F.lit("</p></details>")))


def heading_pairs(spark: SparkSession, d: str) -> DataFrame:
    q, a = _escaped(F.col("question")), _escaped(F.col("answer"))
    return _pairs_page(spark, d, F.concat(F.lit("<h3>"), q, F.lit("</h3><p>"), a, F.lit("</p>")))


def bold_pairs(spark: SparkSession, d: str) -> DataFrame:
    q, a = _escaped(F.col("question")), _escaped(F.col("answer"))
    return _pairs_page(spark, d, F.concat(F.lit("<p><strong>"), q, F.lit("</strong></p><p>"), a, F.lit("</p>")))


def html_table_rows(spark: SparkSession, d: str) -> DataFrame:
    cells = F.concat(*[F.concat(F.lit("<td>"), _escaped(F.col(c).cast("string")), F.lit("</td>")) for c in ("s_suppkey", "s_name", "s_nationkey")])
    body = F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("<tr>"), cells, F.lit("</tr>")))), "")
    pages = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.concat(F.lit("<table><thead><tr><th>Key</th><th>Name</th><th>Nation</th></tr></thead><tbody>"), body, F.lit("</tbody></table>")).alias("html"))
    found = html.read_pages(pages, "s_nationkey").select("s_nationkey", F.explode("tables").alias("t"))
    return found.select("s_nationkey", F.explode(F.split("t.text", "\n")).alias("line"))


def page_links(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "links").filter("source_url is not null and target_url rlike '^https?://'")
    item = F.concat(F.lit('<li><a href="'), _escaped(F.trim("target_url")), F.lit('">'), _escaped(F.coalesce("link_text", F.lit(""))), F.lit("</a></li>"))
    pages = rows.groupBy("source_url").agg(F.concat(F.lit("<ul>"), F.array_join(F.array_sort(F.collect_list(item)), ""), F.lit("</ul>")).alias("html"))
    found = html.read_pages(pages, "source_url").select("source_url", F.explode("links").alias("l"))
    return found.groupBy("source_url", F.col("l.href").alias("href")).agg(F.count("*").alias("n"), F.sum(T.word_count(F.col("l.text"))).alias("words"))


def page_titles(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "pages").select("id", "title").distinct()
    pages = rows.select("id", F.concat(F.lit("<html><head><title>"), _escaped(F.coalesce("title", F.lit(""))), F.lit("</title></head><body><nav>menu</nav><main>Text</main></body></html>")).alias("html"))
    return html.read_pages(pages, "id").select("id", "title", "text")


def csv_rows(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers of each nation as the bytes of CSV files, each of a range of keys and with its header within MOST_ROWS, read back as rendered rows."""
    line = F.concat_ws(",", F.col("s_suppkey").cast("string"), F.concat(F.lit('"'), "s_name", F.lit('"')))
    content = F.encode(F.concat(F.lit("key,name\n"), F.array_join(F.array_sort(F.collect_list(line)), "\n")), "UTF-8")
    part = F.floor(F.col("s_suppkey") / (files.MOST_ROWS - 1))
    rows = table(spark, d, "supplier").groupBy("s_nationkey", part.alias("part")).agg(content.alias("content"))
    rows = rows.select(F.concat(F.lit("n"), F.col("s_nationkey").cast("string"), F.lit(".csv?part="), F.col("part").cast("string")).alias("path"), "content")
    found = files.read_files(rows).select(F.split_part("path", F.lit("?"), F.lit(1)).alias("path"), "status", F.explode("pieces").alias("p"))
    return found.select("path", "status", F.explode(F.slice(F.split("p.text", "\n"), 2, 10_000)).alias("line"))


QUERIES = {f.__name__: f for f in (faq_pairs, details_pairs, heading_pairs, bold_pairs, html_table_rows, page_links, page_titles, csv_rows)}

_WC = r"len(list_filter(string_split(trim(regexp_replace({0}, '[\s\x{A0}\x{3000}\x{2000}-\x{200A}\x{85}\x{1C}-\x{1F}]+', ' ', 'g')), ' '), lambda x: x <> ''))"
_OPEN = ", ".join(f"'{o}'" for o in html.OPENERS)
SQL = {
    "faq_pairs": f"""
        with p as (select distinct source_url, question, answer from chunks where source_url is not null and trim(question) <> '' and trim(answer) <> ''),
        q as (select *, trim(lower(question)) like '%?' or len(list_filter([{_OPEN}], lambda o: starts_with(trim(lower(question)), o))) > 0 as good from p)
        select source_url, count(*) as pairs, sum({_WC.replace('{0}', 'question')} + {_WC.replace('{0}', 'answer')})::bigint as words from q where good group by source_url having count(*) >= 2""",
    "html_table_rows": "select s_nationkey, 'Key: ' || s_suppkey || ' | Name: ' || s_name || ' | Nation: ' || s_nationkey as line from supplier",
    "page_links": f"select source_url, trim(target_url) as href, count(*) as n, sum({_WC.replace('{0}', 'coalesce(link_text, ' + chr(39) * 2 + ')')})::bigint as words from links where source_url is not null and regexp_matches(target_url, '^https?://') group by 1, 2",
    "page_titles": r"select distinct id, nullif(trim(regexp_replace(coalesce(title, ''), '\s+', ' ', 'g')), '') as title, 'Text' as text from pages",
    "csv_rows": "select 'n' || s_nationkey || '.csv' as path, 'ok' as status, 'key: ' || s_suppkey || ' | name: ' || s_name as line from supplier",
}
for _name in ("details_pairs", "heading_pairs", "bold_pairs"):
    SQL[_name] = SQL["faq_pairs"]
