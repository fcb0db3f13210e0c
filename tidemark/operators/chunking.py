"""Texts to chunks: packing of sentences, paragraphs and table rows.

Packing is a fold over the pieces' sizes, which depends on nothing but their order within one text. The sizes of a batch of texts
go to Python as Arrow arrays and come back as ranges; texts stay in the JVM, and nothing is shuffled.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as T

#: Words a chunk aims at and may have, characters it may have, and the part of a chunk repeated in the next.
TARGET_WORDS, MOST_WORDS, MOST_CHARS, OVERLAP = 300, 500, 20_000, 0.20
#: Words a group of paragraphs aims at, and below which the last one joins the one before.
PARAGRAPH_WORDS, TAIL_WORDS = 250, 30
#: Characters from which a group of rows may close and above which it has to.
ROWS_LEAST, ROWS_MOST = 200, 1000
#: Characters below which a chunk's body isn't kept.
LEAST_BODY = 50

def hard_split(piece: Column) -> Column:
    """A string in slices of MOST_CHARS characters."""
    n = F.ceil(F.length(piece) / MOST_CHARS).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.substring(piece, k * MOST_CHARS + 1, F.lit(MOST_CHARS)))


def capped_sentences(found: Column) -> Column:
    """Sentences over MOST_WORDS words or MOST_CHARS characters cut into slices of words, and those into slices of characters."""

    def cut(s: Column) -> Column:
        w = F.filter(F.split(s, " "), lambda x: x != "")
        n = F.ceil(F.size(w) / MOST_WORDS).cast("int")
        slices = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.array_join(F.slice(w, k * MOST_WORDS + 1, F.lit(MOST_WORDS)), " "))
        parts = F.transform(slices, lambda p: F.when(F.length(p) <= MOST_CHARS, F.array(p)).otherwise(hard_split(p)))
        return F.when((F.size(w) <= MOST_WORDS) & (F.length(s) <= MOST_CHARS), F.array(s)).otherwise(F.flatten(parts))

    return F.flatten(F.transform(found, cut))


RANGES = "array<struct<a:int,b:int>>"


def pack(sizes: list[int], target: int, overlap: int) -> list[tuple[int, int]]:
    """The ranges [a, b) into which pieces of the given sizes go, each closed before it would exceed `target`.

    With overlap, the next range starts with the longest run of the closed one's last pieces that has at most `overlap`.
    """
    out, start, size = [], 0, 0
    for i, n in enumerate(sizes):
        if size + n > target and i > start:
            out.append((start, i))
            again, kept = i, 0
            while overlap and again > start and kept + sizes[again - 1] <= overlap:
                again -= 1
                kept += sizes[again]
            start, size = again, kept
        size += n
    return [*out, (start, len(sizes))] if sizes else []


def group(sizes: list[int], least: int, most: int) -> list[tuple[int, int]]:
    """The ranges of rows with the given lengths: one closes before a row with which it would exceed `most`, if it has `least`."""
    out, start, size = [], 0, 0
    for i, n in enumerate(sizes):
        if size + n > most and size >= least:
            out.append((start, i))
            start, size = i, 0
        size += n + 1
    return [*out, (start, len(sizes))] if sizes else []


def _over_sizes(fold, *settings: int):
    """A fold over arrays of sizes as an Arrow function; only the sizes go to Python, the texts stay in the JVM."""

    @F.arrow_udf(RANGES)
    def run(sizes: pa.Array) -> pa.Array:
        found = [[{"a": a, "b": b} for a, b in fold(s, *settings)] if s is not None else None for s in sizes.to_pylist()]
        return pa.array(found, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))

    return run.asNondeterministic()  # else the optimizer copies the call into every expression that uses its result


def _joined(pieces: Column, ranges: Column, between: str) -> Column:
    return F.transform(ranges, lambda r: F.array_join(F.slice(pieces, r["a"] + 1, r["b"] - r["a"]), between))


def semantic(rows: DataFrame, text: str, out: str = "pieces") -> DataFrame:
    """rows with `out`, the chunks of overlapping sentences of `text`.

    A text within the caps is one chunk with its own white space; null, blank and sentence-free texts have none; chunks over
    MOST_CHARS characters are sliced. A chunk may exceed TARGET_WORDS, since the repeated sentences aren't measured again.
    """
    found = rows.withColumn("_sentences", F.coalesce(capped_sentences(T.sentences(F.col(text))), F.array().cast("array<string>")))
    found = found.withColumn("_sizes", F.transform("_sentences", lambda s: F.size(F.filter(F.split(s, " "), lambda w: w != ""))))
    found = found.withColumn("_ranges", _over_sizes(pack, TARGET_WORDS, int(TARGET_WORDS * OVERLAP))(F.col("_sizes")))
    total = F.aggregate("_sizes", F.lit(0), lambda a, x: a + x)
    safe = F.flatten(F.transform(_joined(F.col("_sentences"), F.col("_ranges"), " "), lambda c: F.when(F.length(c) <= MOST_CHARS, F.array(c)).otherwise(hard_split(c))))
    one = (total <= MOST_WORDS) & (F.length(text) <= MOST_CHARS)
    chunks = F.when(F.size("_sentences") == 0, F.array().cast("array<string>")).when(one, F.array(T.stripped(F.col(text)))).otherwise(safe)
    return found.withColumn(out, chunks).drop("_sentences", "_sizes", "_ranges")


def paragraphs(rows: DataFrame, text: str, out: str = "pieces") -> DataFrame:
    """rows with `out`, groups of paragraphs of about PARAGRAPH_WORDS words, joined by a blank line; a short last group joins the one before."""
    pieces = F.filter(F.transform(F.split(F.col(text), "\n+"), T.stripped), lambda p: p != "")
    found = rows.withColumn("_paragraphs", F.coalesce(pieces, F.array().cast("array<string>"))).withColumn("_sizes", F.transform("_paragraphs", T.word_count))
    found = found.withColumn("_ranges", _over_sizes(_with_tail, PARAGRAPH_WORDS, TAIL_WORDS)(F.col("_sizes")))
    whole = F.aggregate("_sizes", F.lit(0), lambda a, x: a + x) <= PARAGRAPH_WORDS
    grouped = _joined(F.col("_paragraphs"), F.col("_ranges"), "\n\n")
    chunks = F.when(F.size("_paragraphs") == 0, F.array().cast("array<string>")).when(whole, F.array(T.stripped(F.col(text)))).otherwise(grouped)
    return found.withColumn(out, chunks).drop("_paragraphs", "_sizes", "_ranges")


def _with_tail(sizes: list[int], target: int, tail: int) -> list[tuple[int, int]]:
    ranges = pack(sizes, target, 0)
    if len(ranges) > 1 and sum(sizes[ranges[-1][0] :]) < tail:
        ranges[-2:] = [(ranges[-2][0], ranges[-1][1])]
    return ranges


def row_groups(rows: DataFrame, rendered: str, out: str = "groups") -> DataFrame:
    """rows with `out`, the rendered rows (array of strings) in groups of ROWS_LEAST to ROWS_MOST characters; a row counts one more for its line end."""
    found = rows.withColumn("_ranges", _over_sizes(group, ROWS_LEAST, ROWS_MOST)(F.transform(rendered, F.length)))
    return found.withColumn(out, F.transform("_ranges", lambda r: F.slice(rendered, r["a"] + 1, r["b"] - r["a"]))).drop("_ranges")


def numbered(rows: DataFrame, pieces: str, hierarchy: Column, least: int = LEAST_BODY, english_only: bool = False) -> DataFrame:
    """A row per kept piece with chunk_index, chunk_total, chunk_id, word_count and n_chars; indexes count kept pieces only."""
    good = lambda p: F.length(T.stripped(T.body(p))) >= least
    kept = F.filter(pieces, (lambda p: good(p) & ~T.is_foreign(p)) if english_only else good)
    out = rows.withColumn("_kept", kept).withColumn("chunk_total", F.size("_kept"))
    out = out.select("*", F.posexplode("_kept").alias("chunk_index", "chunk_text")).drop("_kept", pieces)
    return out.withColumn("chunk_id", T.content_id(F.col("chunk_text"), hierarchy, F.col("chunk_index"))).withColumn("word_count", T.word_count(F.col("chunk_text"))).withColumn("n_chars", F.length("chunk_text"))


def captioned(title: Column, leaf: Column, text: Column) -> Column:
    """The text under the line `[title — leaf]`; without a title, for texts that open with a bracket or with the title itself, unchanged. A leaf that names a file or equals the title is left out."""
    low, name = F.lower(T.stripped(text)), F.lower(T.stripped(title))
    following = F.substring(low, F.length(name) + 1, F.lit(1))
    opens = low.startswith(name) & ~following.rlike(r"(?U)^\w")
    skip = title.isNull() | (T.stripped(title) == "") | text.isNull() | (T.stripped(text) == "") | low.startswith("[") | opens
    shown = leaf.isNotNull() & (leaf != "") & ~leaf.rlike(r"(?i)\.(pdf|docx?|xlsx?|csv|html?)$") & (F.lower(leaf) != name)
    return F.when(skip, text).otherwise(F.concat(F.lit("["), T.stripped(title), F.when(shown, F.concat(F.lit(" — "), leaf)).otherwise(""), F.lit("]\n"), text))
