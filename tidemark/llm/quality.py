"""Statistics of each text, and whether it is prose.

A text up to SEGMENT characters is one segment. A longer one is cut, wherever the cut falls, into segments that go to different
tasks. What a line is depends on lines around it, so a segment counts only what lies between its first and last clean cut
(outline.clean_cuts), and hands on the text before and after as boundary state, with the line that the rest is judged by. Two
neighbouring partial results merge into one: the left's open end and the right's open start become whole lines in their context
and are counted. The merge is associative, and partial results of a text are merged in a tree of groups of WIDTH; the counts are
the same at any segment size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import outline, residue
from tidemark.llm.tokens import LETTER, NUMBER, SPACE, classes
from tidemark.plans.materialize import materialize, small

SEGMENT, WIDTH = 262_144, 16
#: Share of the words outside sentences from which a text is no prose.
LEAST_REST = 0.5
#: The most common English and Spanish words (fixed values).
COMMON = frozenset("the be to of and a in that have it for not on with he as you do at this but his by from they we say her she or an will my one all would there their what so up out if about who get which go me el la de que y en un ser se no por con su para como los las del al es lo".split())
COUNTS = ("chars", "letters", "symbols", "lines", "ending", "words", "word_chars", "common", "prose", "rest")
_END = (".", "!", "?", "…", "。", "！", "？", '."', '!"', '?"', ".'", ".)", ".”", "?”", "!”")


def _ends(line: str) -> bool:
    return line.endswith(_END)


def counts(lines: list[str], kinds: list[int], before: int = outline.BLANK) -> list[int]:
    """The COUNTS of whole lines; before: the kind of the line that stands before them."""
    if not lines:
        return [0] * len(COUNTS)
    text = "\n".join(lines)
    bare = [x for x in map(str.strip, lines) if x]
    words = text.lower().split()
    if text.isascii():
        of = np.bincount(classes()[np.frombuffer(text.encode(), np.uint8)], minlength=5)
        word_chars = len(text) - int(of[SPACE])
    else:
        of = np.bincount(classes()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)], minlength=5)
        word_chars = sum(map(len, text.split()))
    prose, rest = outline.sentences(lines, kinds, before)
    return [
        len(text) - max(0, len(lines) - 1), int(of[LETTER]), word_chars - int(of[LETTER]) - int(of[NUMBER]), len(bare), sum(map(_ends, bare)), len(words), word_chars,
        sum(map(COMMON.__contains__, words)), prose, rest,
    ]


def _kinds(lines: list[str], title: str | None, page: bool) -> list[int]:
    kinds = outline.kinds("\n".join(lines), title)
    return kinds if page else [outline.LABEL if k >= outline.MENU else k for k in kinds]


def partial(text: str, first: bool, last: bool, title: str | None, page: bool) -> dict:
    """The partial result of a segment that starts (first) or ends (last) the text or neither.

    head: the text up to the first clean cut, None if the segment is first; tail: the text from the line before the last clean cut,
    None if it is last; n: the COUNTS between the two. Without a clean cut the segment is all head, with whole=False.
    """
    lines = text.split("\n")
    kinds = _kinds(lines, title, page)
    cuts = [] if first and last else outline.clean_cuts(lines, kinds)
    state = {"title": title, "page": page, "first": first, "last": last}
    if not (first and last) and not cuts:
        return state | {"head": text, "tail": None, "whole": False, "n": [0] * len(COUNTS)}
    a, b = 0 if first else cuts[0], len(lines) if last else cuts[-1]
    n = counts(lines[a:b], kinds[a:b], kinds[a - 1] if a else outline.BLANK)
    return state | {"head": None if first else "\n".join(lines[:a]) + "\n", "tail": None if last else "\n".join(lines[b - 1 :]), "whole": True, "n": n}


def _ahead(tail: str, last: bool, title: str | None, page: bool) -> tuple[list[int], str | None]:
    """The counts of a tail without its first line, which is context, up to its last clean cut, or its end if it is the text's; and what is left of it."""
    lines = tail.split("\n")
    kinds = _kinds(lines, title, page)
    cuts = outline.clean_cuts(lines, kinds)
    b = len(lines) if last else cuts[-1] if cuts else 1
    return counts(lines[1:b], kinds[1:b], kinds[0]), None if last else "\n".join(lines[b - 1 :])


def join(left: dict, right: dict) -> dict:
    """The partial result of two neighbours."""
    title, page = left["title"], left["page"]
    state = {"title": title, "page": page, "first": left["first"], "last": right["last"]}
    if not left["whole"] and not right["whole"]:
        return partial(left["head"] + right["head"], left["first"], right["last"], title, page)
    if not left["whole"]:
        if not left["first"]:
            return state | {"head": left["head"] + right["head"], "tail": right["tail"], "whole": True, "n": right["n"]}
        lines = (left["head"] + right["head"])[:-1].split("\n")
        n = counts(lines, _kinds(lines, title, page))
        return state | {"head": None, "tail": right["tail"], "whole": True, "n": [x + y for x, y in zip(n, right["n"])]}
    if not right["whole"]:
        n, tail = _ahead(left["tail"] + right["head"], right["last"], title, page)
        return state | {"head": left["head"], "tail": tail, "whole": True, "n": [x + y for x, y in zip(left["n"], n)]}
    n, _ = _ahead((left["tail"] + right["head"])[:-1], True, title, page)
    return state | {"head": left["head"], "tail": right["tail"], "whole": True, "n": [x + y + z for x, y, z in zip(left["n"], n, right["n"])]}


def closed(p: dict) -> list[int]:
    """The counts of a whole text from its merged result, which is first and last."""
    if not (p["first"] and p["last"] and p["whole"]):
        raise ValueError("parts of the text are missing")
    return list(p["n"])


_STATE = ("title", "page", "first", "last", "head", "tail", "whole")
_PARTIAL = "title string, page boolean, first boolean, last boolean, head string, tail string, whole boolean, " + ", ".join(f"{c} bigint" for c in COUNTS)


def _columns(found: list[dict]) -> list[pa.Array]:
    kinds = {"title": pa.string(), "head": pa.string(), "tail": pa.string()}
    return [pa.array([p[k] for p in found], kinds.get(k, pa.bool_())) for k in _STATE] + [pa.array([p["n"][k] for p in found], pa.int64()) for k in range(len(COUNTS))]


def statistics(rows: DataFrame, key: str = "chunk_id", text: str = "text", title: str | None = None, kind: str | None = None) -> DataFrame:
    """(key, COUNTS..., mean_word, symbol_ratio, ending_share, common_share, rest_share) of each key's text.

    Null texts and null keys are left out; an empty text has zero counts and null ratios; a key delivered twice is one row; an empty
    table gives no rows. title and kind name columns with the page's title and class, where pages have navigation to leave out of
    prose and rest; lines of class `document` are all judged.
    """
    there = rows.filter(F.col(key).isNotNull() & F.col(text).isNotNull())
    named = there.select(
        F.col(key).alias("id"), F.col(text).alias("text"), (F.col(title) if title else F.lit(None).cast("string")).alias("title"),
        (F.coalesce(F.col(kind), F.lit("")) != "document" if kind else F.lit(False)).alias("page"),
    )
    id_type = named.schema["id"].dataType.simpleString()

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [partial(t, True, True, ti, p)["n"] for t, ti, p in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([n[k] for n in found], pa.int64()) for k in range(len(COUNTS)))], ["id", *COUNTS])

    def long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [partial(t, i == 0, i == n - 1, ti, p) for t, ti, p, i, n in zip(*(batch.column(k).to_pylist() for k in range(1, 6)))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(4), batch.column(5), *_columns(found)], ["id", "part", "parts", *_STATE, *COUNTS],
            )

    def merged(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        whole = None
        for r in table.to_pylist():
            p = {k: r[k] for k in _STATE} | {"n": [r[c] for c in COUNTS]}
            whole = p if whole is None else join(whole, p)
        one = table.slice(0, 1)
        return pa.Table.from_arrays([one["id"], pa.array([one["part"][0].as_py() // WIDTH], pa.int32()), one["parts"], *_columns([whole])], ["id", "part", "parts", *_STATE, *COUNTS])

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [closed({k: r[k] for k in _STATE} | {"n": [r[c] for c in COUNTS]}) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([n[k] for n in found], pa.int64()) for k in range(len(COUNTS)))], ["id", *COUNTS])

    flat = f"id {id_type}, " + ", ".join(f"{c} bigint" for c in COUNTS)
    length = F.length("text")
    out = named.filter(length <= SEGMENT).mapInArrow(short, flat)
    huge = materialize(named.filter(length > SEGMENT), "huge")
    if (most := huge.agg(F.max(length)).first()[0]) is not None:
        parts = F.ceil(length / SEGMENT).cast("int")
        cut = huge.dropDuplicates(["id"]).withColumn("parts", parts).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        cut = cut.select("id", F.substring("text", F.col("part") * SEGMENT + 1, F.lit(SEGMENT)).alias("text"), "title", "page", "part", "parts").repartition("id", "part")
        schema = f"id {id_type}, part int, parts int, {_PARTIAL}"
        level, groups = cut.mapInArrow(long, schema), -(-most // SEGMENT)
        while groups > 1:
            level = level.groupBy("id", F.floor(F.col("part") / WIDTH).alias("g")).applyInArrow(merged, schema)
            groups = -(-groups // WIDTH)
        out = out.unionByName(level.drop("part", "parts").mapInArrow(close, flat))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return out.distinct().select(
        F.col("id").alias(key), *COUNTS, ratio("word_chars", "words").alias("mean_word"), ratio("symbols", "word_chars").alias("symbol_ratio"), ratio("ending", "lines").alias("ending_share"), ratio("common", "words").alias("common_share"),
        F.when(F.col("prose") + F.col("rest") > 0, F.col("rest") / (F.col("prose") + F.col("rest"))).alias("rest_share"),
    )


def find_no_prose(chunks: DataFrame) -> DataFrame:
    """chunk_id of the chunks of which at least LEAST_REST of the words stand outside sentences; error pages, filler and unfilled templates left out.

    Judged without the lines of pages that are no content; a chunk without other words isn't found. Nulls, repeats and empty tables
    as in statistics(). Texts up to SEGMENT characters are read once for both questions.
    """
    rows = chunks.filter(F.col("chunk_id").isNotNull() & (F.trim("text") != "")).select("chunk_id", "text", "title", "page_classification")
    kind = rows.schema["chunk_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, told = [], []
            for text, title, c in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                kinds.append(outline.kinds(text, title))
                if len(text) > SEGMENT:
                    told.append(None)
                    continue
                mine = kinds[-1] if c != "document" else [outline.LABEL if k >= outline.MENU else k for k in kinds[-1]]
                prose, rest = outline.sentences(text.split("\n"), mine)
                told.append(rest > 0 and rest >= LEAST_REST * (prose + rest))
            yield pa.RecordBatch.from_arrays([batch.column(0), *residue.read_texts(batch, kinds), pa.array(told, pa.bool_())], ["id", "sure", "trusted", "body", "words", "told"])

    texts = materialize(rows.mapInArrow(read, f"id {kind}, {residue.READ}, told boolean"), "texts")
    found = texts.filter("told").select("id")
    if not texts.filter("told is null").isEmpty():
        long = statistics(rows.filter(F.length("text") > SEGMENT), title="title", kind="page_classification")
        found = found.unionByName(long.filter(F.col("rest_share") >= LEAST_REST).select(F.col("chunk_id").alias("id")))
    out = found.distinct().join(small(materialize(residue.residue_ids(texts), "residue-ids")), "id", "left_anti")
    return out.select(F.col("id").alias("chunk_id"))
