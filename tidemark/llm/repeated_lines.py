"""Lines repeated across the documents of one site.

1. Each document becomes one hash per line (of the line's letters), deliveries of one document are merged, and the result is
   written once; later steps read hashes, not texts.
2. Each partition makes one mergeable summary per site: Misra-Gries counters over the distinct lines of each document, cut
   further by a share of the documents seen. A summary carries by how much it may undercount.
3. Summaries are added up. A line is a candidate where its count plus the site's total undercount reaches the threshold. Where
   that total alone reaches it (a site with very many different lines), all lines of the site are candidates, so that no
   line is lost at any size.
4. Candidates are counted exactly in a second pass, and confirmed lines are taken out of each text with broadcast sets.

A hot site is spread over all partitions in every step: no step gathers a site's rows in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.texts import lines, one_delivery, site
from tidemark.plans.materialize import materialize, small

#: A line with fewer letters doesn't count.
LEAST_LETTERS = 12
#: Documents of a site that must have the line, at least, and their share of the site's documents.
LEAST_DOCUMENTS, LEAST_SHARE = 5, 0.05
#: Misra-Gries counters per site and partition.
COUNTERS = 4096
#: Part of the threshold that a partition's cut may use up.
CUT = 0.8
#: Rows gathered before a summary is reduced.
REDUCE_AT = 400_000


def line_key(line: Column) -> Column:
    """A 64-bit hash of the line's letters, lower-cased; null where there are fewer than LEAST_LETTERS."""
    letters = F.regexp_replace(F.lower(line), r"\P{L}+", "")
    return F.when(F.length(letters) >= LEAST_LETTERS, F.xxhash64(letters))


def keyed_lines(chunks: DataFrame, key: str = "chunk_id", text: str = "text", url: str = "source_url") -> DataFrame:
    """(key, site, keys): per document the hash of each line, by position. Documents without a site are left out; null text has no lines."""
    rows = chunks.select(F.col(key), site(F.col(url)).alias("site"), F.transform(lines(F.col(text)), line_key).alias("keys"))
    return one_delivery(rows.filter(F.col("site").isNotNull()), key, "site", "keys")


def _reduced(table: pa.Table) -> tuple[pa.Table, dict[str, int]]:
    """The counts added up, at most COUNTERS per site left, and by how much each site's counts were lowered."""
    sums = table.group_by(["site", "line"]).aggregate([("n", "sum")]).rename_columns(["site", "line", "n"])
    sites = sums["site"].combine_chunks().dictionary_encode()
    code, n = sites.indices.to_numpy(zero_copy_only=False), sums["n"].to_numpy()
    sizes = np.bincount(code)
    if not (sizes > COUNTERS).any():
        return sums, {}
    names, order = sites.dictionary.to_pylist(), np.lexsort((-n, code))
    first = np.concatenate(([0], np.cumsum(sizes)))
    lower = np.zeros(len(sizes), np.int64)
    for s in np.flatnonzero(sizes > COUNTERS):
        lower[s] = n[order[first[s] + COUNTERS]]
    left = n - lower[code]
    return (
        pa.table({"site": sums["site"], "line": sums["line"], "n": pa.array(left)}).filter(pa.array(left > 0)),
        {names[s]: int(lower[s]) for s in np.flatnonzero(lower)},
    )


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(site, lines distinct within a document) -> (site, line, n): counters, and in rows with null line the site's possible undercount."""
    parts: list[pa.Table] = []
    seen: dict[str, int] = {}
    lowered: dict[str, int] = {}
    waiting = 0

    def reduce() -> None:
        nonlocal parts, waiting
        table, less = _reduced(pa.concat_tables(parts))
        for s, n in less.items():
            lowered[s] = lowered.get(s, 0) + n
        parts, waiting = [table], 0

    for batch in batches:
        column = batch.column("site")
        for x in column.value_counts().to_pylist():
            seen[x["values"]] = seen.get(x["values"], 0) + x["counts"]
        lists = batch.column("keys")
        flat = pc.list_flatten(lists)
        parts.append(pa.table({"site": column.take(pc.list_parent_indices(lists)), "line": flat, "n": pa.array(np.ones(len(flat), np.int64))}))
        waiting += len(flat)
        if waiting >= REDUCE_AT:
            reduce()
    if not seen:
        return
    reduce()
    table = parts[0]
    cut = {s: int(CUT * LEAST_SHARE * n) for s, n in seen.items()}
    sites = table["site"].combine_chunks().dictionary_encode()
    bound = np.array([cut[s] for s in sites.dictionary.to_pylist()], np.int64)
    if len(table):
        table = table.filter(pa.array(table["n"].to_numpy() > bound[sites.indices.to_numpy(zero_copy_only=False)]))
    tail = pa.table({"site": pa.array(list(seen), pa.string()), "line": pa.array([None] * len(seen), pa.int64()), "n": pa.array([cut[s] + lowered.get(s, 0) for s in seen], pa.int64())})
    yield from pa.concat_tables([table.cast(tail.schema), tail]).combine_chunks().to_batches(max_chunksize=100_000)


def repeated_lines(keyed: DataFrame) -> DataFrame:
    """(site, line, n_documents) of the lines in at least LEAST_DOCUMENTS documents and LEAST_SHARE of the documents of their site.

    keyed: a materialised table of keyed_lines().
    """
    totals = keyed.groupBy("site").agg(F.count("*").alias("total"))
    distinct = keyed.select("site", F.array_distinct(F.filter("keys", lambda k: k.isNotNull())).alias("keys")).filter(F.size("keys") > 0)
    summary = distinct.mapInArrow(_summaries, "site string, line bigint, n bigint")
    summed = materialize(summary.groupBy("site", "line").agg(F.sum("n").alias("n")), "summary")
    thresholds = totals.join(summed.filter(F.col("line").isNull()).select("site", F.col("n").alias("under")), "site").select(
        "site", "total", "under", F.greatest(F.lit(LEAST_DOCUMENTS), F.ceil(F.col("total") * LEAST_SHARE - 1e-9)).alias("least")
    )
    thresholds = materialize(thresholds, "thresholds")
    per_site = small(thresholds)
    each = distinct.join(per_site, "site").select("site", F.explode("keys").alias("line"), "total", "least", "under")
    open_sites = thresholds.filter(F.col("under") >= F.col("least"))
    named = materialize(
        summed.filter(F.col("line").isNotNull()).join(per_site, "site").filter((F.col("under") < F.col("least")) & (F.col("n") + F.col("under") >= F.col("least"))).select("site", "line"),
        "candidates",
    )
    counted = each.join(small(named), ["site", "line"], "left_semi")
    if open_sites.count():
        counted = counted.unionByName(each.filter(F.col("under") >= F.col("least")))
    exact = counted.groupBy("site", "line").agg(F.count("*").alias("n_documents"), F.first("least").alias("least"))
    return exact.filter(F.col("n_documents") >= F.col("least")).select("site", "line", "n_documents")


def find_repeated_lines(chunks: DataFrame) -> DataFrame:
    """(chunk_id, line_no) of every line that repeated_lines() confirms, line numbers from 0 as in the text.

    Chunks without source_url are left out; null texts count in a site's total and have no lines; lines with few letters never
    count; repeated deliveries are one chunk; an empty table gives no rows; other columns don't matter.
    """
    keyed = materialize(keyed_lines(chunks), "line-keys")
    confirmed = materialize(repeated_lines(keyed), "confirmed")
    each = keyed.select("chunk_id", "site", F.posexplode("keys").alias("line_no", "line")).filter(F.col("line").isNotNull())
    return each.join(small(confirmed), ["site", "line"], "left_semi").select("chunk_id", "line_no")


def without_repeated_lines(chunks: DataFrame) -> DataFrame:
    """(chunk_id, text, removed): each chunk once, its text without the confirmed lines of its site and otherwise untouched.

    The set of a site is small by definition: a line takes LEAST_SHARE of the documents, so a site has at most 1 / LEAST_SHARE
    times as many confirmed lines as a document has lines on average. Null text stays null, chunks without a site are kept as they are.
    """
    keyed = materialize(keyed_lines(chunks), "line-keys")
    sets = materialize(repeated_lines(keyed).groupBy("site").agg(F.collect_set("line").alias("repeated")), "sets")
    rows = one_delivery(chunks, "chunk_id", "source_url", "text").withColumn("site", site(F.col("source_url")))
    marked = rows.join(small(sets), "site", "left").withColumn("lines", lines(F.col("text")))
    kept = F.filter("lines", lambda x: ~F.coalesce(F.array_contains("repeated", line_key(x)), F.lit(False)))
    kept = F.when(F.col("repeated").isNull(), F.col("lines")).otherwise(kept)
    return marked.withColumn("kept", kept).select("chunk_id", F.array_join("kept", "\n").alias("text"), (F.size("lines") - F.size("kept")).alias("removed"))
