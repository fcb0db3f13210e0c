"""Exact nearest neighbours by cosine, and measures of retrieval.

Queries are a stated set and go against all rows in blocks: a block of at most BLOCK query vectors is broadcast, each batch of
rows is multiplied with it at once and gives its own best k per query, and the bests of all batches are ranked. What leaves an
executor is k rows per query and batch, whatever the table's size.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK = 4096
_OUT = "query bigint, id bigint, score double, rank_key double"


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; zero vectors stay zero."""
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, size, out=np.zeros_like(rows), where=size > 0)


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5, key: str = "id", vector: str = "embedding", penalty: str | None = None, floor: float | None = None) -> DataFrame:
    """(query, id, rank, score): the k rows of highest cosine for each query, by score less `penalty` (a column of rows), ties to the lower id.

    A floor drops rows of the k afterwards, so that fewer may remain. Null vectors and keys are left out, vectors of another length
    than a query's raise; a query that is itself a row finds itself.
    """
    columns = [key, vector, *([penalty] if penalty else [])]
    there = rows.filter(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(*columns)
    out = None
    source = iter(queries.filter(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(key, vector).toLocalIterator())
    while block := list(itertools.islice(source, BLOCK)):
        ids = np.array([r[0] for r in block], np.int64)
        shared = rows.sparkSession.sparkContext.broadcast((ids, unit(np.array([r[1] for r in block], float))))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, matrix = shared.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                own = batch.column(0).to_numpy()
                flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
                score = matrix @ unit(flat).T
                by = score - (batch.column(2).to_numpy(zero_copy_only=False)[None, :] if penalty else 0.0)
                best = np.lexsort((np.broadcast_to(own, by.shape), -np.round(by, 12)), axis=1)[:, :k]
                q = np.repeat(np.arange(len(names)), best.shape[1])
                r = best.ravel()
                yield pa.RecordBatch.from_arrays([pa.array(names[q]), pa.array(own[r].astype(np.int64)), pa.array(score[q, r]), pa.array(by[q, r])], ["query", "id", "score", "rank_key"])

        part = there.mapInArrow(run, _OUT)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return rows.sparkSession.createDataFrame([], "query bigint, id bigint, rank int, score double")
    order = Window.partitionBy("query").orderBy(F.desc(F.round("rank_key", 12)), "id")
    ranked = out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    if floor is not None:
        ranked = ranked.filter(F.col("score") >= floor)
    return ranked.select("query", "id", "rank", "score")


def retrieval_metrics(ranked: DataFrame, relevant: str, segment: str, k: int = 5) -> DataFrame:
    """(segment, n, hit_1, hit_k, mrr, p_k) per segment and, under null, over all; ranked has a row per query and rank with the boolean `relevant`."""
    first = ranked.groupBy(segment, "query").agg(F.min(F.when(F.col(relevant), F.col("rank"))).alias("first"), F.count_if(F.col(relevant) & (F.col("rank") <= k)).alias("good"))
    r = F.col("first")
    return first.rollup(segment).agg(
        F.count("*").alias("n"), F.avg(F.coalesce((r == 1).cast("double"), F.lit(0.0))).alias("hit_1"), F.avg(F.coalesce((r <= k).cast("double"), F.lit(0.0))).alias("hit_k"),
        F.avg(F.coalesce(1 / r, F.lit(0.0))).alias("mrr"), (F.sum("good") / (F.count("*") * k)).alias("p_k"),
    )
