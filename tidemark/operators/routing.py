"""From a page's or file's extraction to chunks: which strategy applies, what each piece carries, and what becomes of a run's pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import chunking as C

#: Payload kinds by content type and by extension (fixed values).
BY_TYPE = {
    "application/pdf": "pdf", "application/msword": "doc", "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx", "application/vnd.ms-excel": "xls",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "xlsx", "text/csv": "csv", "text/html": "html", "application/xhtml+xml": "html", "text/plain": "txt",
}
BY_EXTENSION = {"pdf": "pdf", "doc": "doc", "docx": "docx", "xls": "xls", "xlsx": "xlsx", "xlsm": "xlsx", "csv": "csv", "htm": "html", "html": "html", "txt": "txt"}
#: Words up to which a document's section, and a file's text, stays whole.
WHOLE_SECTION, WHOLE_FILE = 300, 150
#: Signs of words below which extracted text counts as none; words of a short document; question marks, and their part of the lines, of an FAQ (fixed values).
LEAST_SIGNS, SHORT_WORDS, LEAST_QUESTIONS, QUESTION_SHARE = 20, 150, 5, 0.05


def payload_kind(content_type: Column, extension: Column) -> Column:
    """The kind of a payload by its content type, parameters and case ignored, else by its extension; null if neither is known."""
    types = F.create_map(*[x for pair in BY_TYPE.items() for x in map(F.lit, pair)])
    extensions = F.create_map(*[x for pair in BY_EXTENSION.items() for x in map(F.lit, pair)])
    bare = F.lower(F.trim(F.substring_index(content_type, ";", 1)))
    return F.coalesce(F.try_element_at(types, bare), F.try_element_at(extensions, F.lower(extension)))


def is_blank_extraction(text: Column) -> Column:
    """Effectively no text: null or fewer than LEAST_SIGNS letters, digits and underscores."""
    return F.coalesce(F.regexp_count(text, F.lit(r"(?U)\w")) < LEAST_SIGNS, F.lit(True))


def cascade(*texts: Column) -> tuple[Column, Column]:
    """(text, place): the first extraction that isn't effectively empty and its place from 1; else the first scrap that isn't blank, else null."""
    good = [F.when(~is_blank_extraction(t), F.struct(t.alias("t"), F.lit(i + 1).alias("p"))) for i, t in enumerate(texts)]
    scraps = [F.when(F.coalesce(T.stripped(t), F.lit("")) != "", F.struct(t.alias("t"), F.lit(i + 1).alias("p"))) for i, t in enumerate(texts)]
    best = F.coalesce(*good, *scraps)
    return best["t"], best["p"]


def document_structure(text: Column, tables: Column) -> Column:
    """empty, tables (two or more), faq (many question marks), short or prose."""
    questions = F.regexp_count(text, F.lit(r"\?"))
    lines = F.size(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""))
    return (
        F.when(is_blank_extraction(text), "empty").when(tables >= 2, "tables").when((questions >= LEAST_QUESTIONS) & (questions / F.greatest(lines, F.lit(1)) > QUESTION_SHARE), "faq")
        .when(T.word_count(text) < SHORT_WORDS, "short").otherwise("prose")
    )


def effective_strategy(kind: Column, strategy: Column, found: Column, text: Column) -> Column:
    """The strategy that is really used: documents by their structure, FAQ and table pages without pairs or rows as simple text, skipped ones as they are."""
    structure = document_structure(text, F.lit(0))
    document = F.when(structure == "empty", "none").when(structure == "short", "single").when(structure == "faq", "paragraphs").otherwise("semantic")
    return (
        F.when(F.coalesce(strategy, F.lit("")) == "skip", "skip").when(kind == "doc", "none").when(kind.isin("xlsx", "xls", "csv"), "sheet_rows").when(kind.isin("pdf", "docx"), document)
        .when(strategy.isin("qa_pairs", "table_rows") & (found == 0), "simple_split").otherwise(F.coalesce(strategy, F.lit("simple_split")))
    )


def page_result(chunks: Column, error: Column, changed: Column) -> Column:
    """What became of a page in a run: unchanged, failed, success, or deliberately no chunk."""
    return F.when(~changed, "unchanged").when(error.isNotNull(), "failed").when(chunks > 0, "success").otherwise("deliberate zero")


def without_banner(text: Column, markers: list[str]) -> Column:
    """A text that starts with one of the markers loses its first line; one without a line end stays."""
    low = F.lower(text)
    starts = F.lit(False)
    for m in markers:
        starts = starts | low.startswith(m.lower())
    return F.when(starts & F.contains(text, F.lit("\n")), F.ltrim(F.substring(text, F.instr(text, "\n") + 1, F.length(text)))).otherwise(text)


def hierarchy(value: Column) -> Column:
    """A hierarchy given as JSON text as an array; other text is an array of itself, null and empty an empty one."""
    parsed = F.from_json(value, "array<string>")
    return F.when(F.coalesce(F.trim(value), F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.coalesce(parsed, F.array(value)))


def metadata(urls: Column, title: Column, levels: Column, kind: Column, strategy: Column, extras: dict[str, Column], allowed: list[str]) -> Column:
    """A chunk's metadata: the first URL is its own, all of them once in their order; of the extras only allowed ones."""
    known = F.array_distinct(F.filter(urls, lambda u: u.isNotNull()))
    return F.struct(
        F.try_element_at(known, F.lit(1)).alias("source_url"), known.alias("source_urls"), title.alias("title"), levels.alias("section_hierarchy"), kind.alias("page_classification"),
        strategy.alias("chunking_strategy"), *[c.alias(n) for n, c in extras.items() if n in allowed],
    )


def capped_answers(rows: DataFrame, question: str, answer: str) -> DataFrame:
    """rows with `pieces`: long answers cut within the chunk limits, each piece after its question."""
    cut = C.semantic(rows.withColumn("_a", T.stripped(F.col(answer))), "_a").drop("_a")
    q = T.stripped(F.col(question))
    return cut.withColumn("pieces", F.transform("pieces", lambda p: F.concat(F.lit("Q: "), q, F.lit("\nA: "), p)))


def file_pieces(rows: DataFrame, text: str) -> DataFrame:
    """rows with `pieces` of a file's text: whole up to WHOLE_FILE words, else semantic ones, else paragraphs; pieces under 50 characters are dropped."""
    bare = rows.withColumn("_t", T.stripped(F.coalesce(F.col(text), F.lit(""))))
    cut = C.semantic(bare, "_t").withColumnRenamed("pieces", "_semantic")
    cut = C.paragraphs(cut, "_t")
    pieces = F.when(T.word_count(F.col("_t")) <= WHOLE_FILE, F.array("_t")).when(F.size("_semantic") > 0, F.col("_semantic")).otherwise(F.col("pieces"))
    return cut.withColumn("pieces", F.filter(pieces, lambda p: F.length(F.trim(p)) >= 50)).drop("_t", "_semantic")


def claims(pages: DataFrame, key: str, digest: str, finished: Column, skipped: Column) -> DataFrame:
    """(key, digest, first): of the pages with a hash that came with the fetch, the least key that finished and wasn't skipped claims it; others of the hash name it."""
    rows = pages.select(key, digest, (finished & ~skipped).alias("_ok")).dropna(subset=[key, digest])
    first = rows.groupBy(digest).agg(F.min(F.when(F.col("_ok"), F.col(key))).alias("first"))
    return rows.join(first, digest).select(key, digest, "first")


def has_columns(rows: Column) -> Column:
    """Whether a table (array of arrays of cells) has a row with two cells that aren't empty."""
    return F.coalesce(F.exists(rows, lambda r: F.size(F.filter(r, lambda c: F.coalesce(F.trim(c), F.lit("")) != "")) >= 2), F.lit(False))


def two_columns(blocks: DataFrame, page: str = "page") -> DataFrame:
    """(page, two): whether text blocks (x0, x1, y0, y1, width) stand in two columns: at least two blocks on either side of the middle, and some of either beside each other."""
    middle = F.col("width") / 2
    side = F.when(F.col("x1") <= middle * 1.05, "left").when(F.col("x0") >= middle * 0.95, "right")
    sided = blocks.withColumn("_side", side)
    sums = sided.groupBy(page).agg(
        F.count_if(F.col("_side") == "left").alias("l"), F.count_if(F.col("_side") == "right").alias("r"),
        F.min(F.when(F.col("_side") == "left", F.col("y0"))).alias("la"), F.max(F.when(F.col("_side") == "left", F.col("y1"))).alias("lb"),
        F.min(F.when(F.col("_side") == "right", F.col("y0"))).alias("ra"), F.max(F.when(F.col("_side") == "right", F.col("y1"))).alias("rb"),
    )
    return sums.select(page, F.coalesce((F.col("l") >= 2) & (F.col("r") >= 2) & (F.col("la") < F.col("rb")) & (F.col("ra") < F.col("lb")), F.lit(False)).alias("two"))


def reading_order(blocks: DataFrame, page: str = "page") -> DataFrame:
    """blocks with `place`: from top to bottom; in pages of two columns, blocks across the middle divide bands, in which the left column comes before the right one."""
    from pyspark.sql.window import Window

    middle = F.col("width") / 2
    across = (F.col("x0") < middle * 0.95) & (F.col("x1") > middle * 1.05)
    down = Window.partitionBy(page).orderBy("y0", "x0", "block")
    rows = blocks.join(two_columns(blocks, page), page).withColumn("_across", F.col("two") & across)
    band = F.sum(F.col("_across").cast("int")).over(down.rowsBetween(Window.unboundedPreceding, 0)) * 2 - F.col("_across").cast("int")
    column = F.when(~F.col("two") | F.col("_across"), 0).when(F.col("x0") >= middle * 0.95, 1).otherwise(0)
    rows = rows.withColumn("_band", F.when(F.col("two"), band).otherwise(0)).withColumn("_column", column)
    place = F.row_number().over(Window.partitionBy(page).orderBy("_band", "_column", "y0", "x0", "block"))
    return rows.withColumn("place", place).drop("_across", "_band", "_column")
