"""The main content of pages, by ratios of tag paths.

Each line is a leaf of the page's rebuilt tag tree; its path is root, zone (before, in or after the body), the enclosing block and
the leaf's tag with its marker (outline.py). Over the whole corpus, text length and punctuation are added up per path; the two
ratios are smoothed towards those of the path's block and of the corpus and fused, and paths under the threshold are no content.
Headings, entries of lists and tables and remains within the body are as short as navigation, so tags that announce content have
CONTENT to their credit; nothing is held against the others but their ratios, by which alone a path is rejected. There are at most
a few hundred paths, so their sums are all that leaves the executors.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import outline

#: Characters to which the snippets of pages are shortened.
SNIPPET = 500
#: Lines with which a path's ratios are smoothed.
PRIOR_LINES = 20
#: What tags that announce content count, in the units of the log ratios.
CONTENT = 3.5
#: Weights of the log ratios of text length and punctuation, and the threshold of the fused score.
WEIGHTS, THRESHOLD = (0.75, 0.25), 0.0
_PUNCTUATION = set(".,;:!?。，！？¿¡")


def paths(kinds: list[int]) -> list[str | None]:
    """The path of each line; None for blank lines."""
    body = [i for i, k in enumerate(kinds) if k in (outline.PROSE, outline.ROW, outline.ITEM, outline.JUNK)]
    first, last = (body[0], body[-1]) if body else (len(kinds), -1)
    out: list[str | None] = []
    for i, k in enumerate(kinds):
        if k == outline.BLANK:
            out.append(None)
        else:
            zone = "main" if first <= i <= last else "header" if i < first else "footer"
            out.append(f"html>{zone}>{outline.NAMES[k].replace('.', '>')}")
    return out


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, key, text, title) -> per path of a task: lines, characters, punctuation marks."""
    total: dict[str, list[int]] = defaultdict(lambda: [0, 0, 0])
    for batch in batches:
        for kind, text, title in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            kinds = outline.kinds(text, title, kind == "page" and len(text) >= SNIPPET)
            for path, line in zip(paths(kinds), text.split("\n")):
                if path:
                    t = total[path]
                    t[0] += 1
                    t[1] += len(line)
                    t[2] += sum(map(line.count, _PUNCTUATION))
    if total:
        rows = list(total.items())
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows]), *(pa.array([t[k] for _, t in rows], pa.int64()) for k in range(3))], ["path", "n", "chars", "marks"])


def content_scores(sums: list[tuple[str, int, int, int]]) -> dict[str, float]:
    """The fused score of each path from its sums."""
    blocks: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0, 0.0])
    whole = [0.0, 0.0, 0.0]
    for path, *t in sums:
        for k in range(3):
            blocks[path.rpartition(">")[0]][k] += t[k]
            whole[k] += t[k]
    out = {}
    # the ratios of the path on which a character, or a mark, of the corpus stands on average
    base = [sum(t[k] * t[k] / t[1] for t in sums) / max(whole[k - 1], 1) for k in (2, 3)]
    tags = tuple(">" + name.replace(".", ">") for kind, name in outline.NAMES.items() if kind < outline.MENU)
    for path, n, chars, marks in sums:
        score = CONTENT if path.endswith(tags) else 0.0
        block = blocks[path.rpartition(">")[0]]
        for weight, got, k, mean in zip(WEIGHTS, (chars, marks), (1, 2), base):
            above = (block[k] + PRIOR_LINES * mean) / (block[0] + PRIOR_LINES)
            ratio = (got + PRIOR_LINES * above) / (n + PRIOR_LINES)
            score += weight * math.log(max(ratio, 1e-3) / max(mean, 1e-3))
        out[path] = score
    return out


def records(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """(record_kind, record_key, text, title) of the chunks of HTML pages and the snippets of crawled HTML pages, texts not null.

    Deliveries of a chunk agree; of a page, every state's snippet that was crawled as HTML is a record of its id.
    """
    a = chunks.filter((F.coalesce("page_classification", F.lit("")) != "document") & F.col("chunk_id").isNotNull() & F.col("text").isNotNull())
    b = pages.filter((F.col("content_type") == "html") & (F.col("crawl_status") == "crawled") & F.col("id").isNotNull() & F.col("extracted_snippet").isNotNull())
    return a.select(F.lit("chunk").alias("record_kind"), F.col("chunk_id").cast("string").alias("record_key"), "text", "title").unionByName(
        b.select(F.lit("page").alias("record_kind"), F.col("id").cast("string").alias("record_key"), F.col("extracted_snippet").alias("text"), "title")
    )


def rejected_paths(rows: DataFrame) -> list[str]:
    """The paths of the corpus that are no content. At most zones x tags rows come to the driver."""
    sums = rows.mapInArrow(_sums, "path string, n bigint, chars bigint, marks bigint").groupBy("path").agg(*[F.sum(c).alias(c) for c in ("n", "chars", "marks")])
    scores = content_scores([tuple(r) for r in sums.collect()])
    return sorted(p for p, s in scores.items() if s < THRESHOLD)


def find_boilerplate(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """(record_kind, record_key, line_no) of the lines that are no main content.

    Null texts have no rows, an empty text has only a blank line, which is none; records delivered twice give their lines once; an
    empty table gives no rows; other columns don't matter.
    """
    rows = records(chunks, pages)
    rejected = set(rejected_paths(rows))

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for kind, key, text, title in zip(*(batch.column(k).to_pylist() for k in range(4))):
                kinds = outline.kinds(text, title, kind == "page" and len(text) >= SNIPPET)
                for i, path in enumerate(paths(kinds)):
                    if path in rejected:
                        out[0].append(kind)
                        out[1].append(key)
                        out[2].append(i)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int32())], ["record_kind", "record_key", "line_no"])

    return rows.mapInArrow(lines, "record_kind string, record_key string, line_no int").distinct()


def main_content(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """(record_kind, record_key, text): each record once with its content lines only; records as in find_boilerplate()."""
    rows = records(chunks, pages)
    rejected = set(rejected_paths(rows))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for kind, text, title in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                marks = paths(outline.kinds(text, title, kind == "page" and len(text) >= SNIPPET))
                texts.append("\n".join(line for line, p in zip(text.split("\n"), marks) if p not in rejected))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["record_kind", "record_key", "text"])

    return rows.dropDuplicates(["record_kind", "record_key", "text"]).mapInArrow(keep, "record_kind string, record_key string, text string")
