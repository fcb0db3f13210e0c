"""Keeping a manifest, its chunks and a store of vectors in step: first and last rows, upserts, merges, coverage, audits.

Choices of one row per key are aggregations with min_by/max over a struct, which combine before the shuffle; no key's rows are
gathered. Nulls in keys are left out unless said otherwise; ties fall to the greatest, or least, of the remaining columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.plans.materialize import small


def first_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that comes first by the order columns (nulls first); rows with a null key are left out."""
    rest = [c for c in rows.columns if c not in keys]
    ordered = [*order, *[c for c in rest if c not in order]]
    best = rows.dropna(subset=keys).groupBy(*keys).agg(F.min(F.struct(*ordered)).alias("_best"))
    return best.select(*keys, *[F.col(f"_best.{c}").alias(c) for c in rest])


def last_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that comes last by the order columns (nulls least)."""
    rest = [c for c in rows.columns if c not in keys]
    ordered = [*order, *[c for c in rest if c not in order]]
    best = rows.dropna(subset=keys).groupBy(*keys).agg(F.max(F.struct(*ordered)).alias("_best"))
    return best.select(*keys, *[F.col(f"_best.{c}").alias(c) for c in rest])


def insert_or_ignore(table: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The table with those new rows whose key it doesn't have; of several new rows of a key the first by `order`."""
    return table.unionByName(first_of(new, keys, order).join(table.select(*keys).distinct(), keys, "left_anti").select(*table.columns))


def coalesce_update(table: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The table with the columns of new rows (key unique) where these aren't null, and its own where they are."""
    fresh = new.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    return table.join(fresh, key, "left").select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in columns else c for c in table.columns])


def upsert(table: DataFrame, new: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The table with all columns of a key replaced by the last of its new rows; doing it twice changes nothing."""
    fresh = last_of(new, [key], order)
    return table.join(fresh.select(key), key, "left_anti").select(*table.columns).unionByName(fresh.select(*table.columns))


def snapshot(pages: DataFrame, covered: DataFrame | None = None) -> DataFrame:
    """pages with previous_content_hash set to content_hash where that isn't null, of all pages or of those with the covered urls."""
    if covered is None:
        return pages.withColumn("previous_content_hash", F.coalesce("content_hash", "previous_content_hash"))
    marked = pages.join(small(covered.select(F.col("url"), F.lit(True).alias("_covered")).distinct()), "url", "left")
    return marked.withColumn("previous_content_hash", F.when(F.col("_covered"), F.coalesce("content_hash", "previous_content_hash")).otherwise(F.col("previous_content_hash"))).drop("_covered")


def clear_snapshot(pages: DataFrame, failed: DataFrame) -> DataFrame:
    """pages with previous_content_hash null for the failed urls, so that the next run takes them again."""
    marked = pages.join(small(failed.select("url", F.lit(True).alias("_failed")).distinct()), "url", "left")
    return marked.withColumn("previous_content_hash", F.when(F.col("_failed").isNull(), F.col("previous_content_hash"))).drop("_failed")


def needs_work(now: Column, before: Column, kind: Column, strategy: Column) -> Column:
    """A page to look at again: never snapshotted, changed, or a document (whose bytes are compared later) that isn't skipped."""
    return before.isNull() | (now.isNotNull() & (now != before)) | ((kind != "html") & (F.coalesce(strategy, F.lit("")) != "skip"))


def merge_chunks(kept: DataFrame, new: DataFrame, reprocessed: DataFrame, expected: DataFrame) -> DataFrame:
    """Chunks none of whose urls was reprocessed and of which some url is still expected, and the new chunks.

    kept and new have chunk_id and urls (array); reprocessed and expected have url.
    """
    each = kept.select("chunk_id", F.explode("urls").alias("url")).distinct()
    gone = each.join(reprocessed.select("url").distinct(), "url", "left_semi").select("chunk_id").distinct()
    still = each.join(expected.select("url").distinct(), "url", "left_semi").select("chunk_id").distinct()
    return kept.join(gone, "chunk_id", "left_anti").join(still, "chunk_id", "left_semi").select(*kept.columns).unionByName(new.select(*kept.columns))


def uncovered(expected: DataFrame, chunks: DataFrame) -> DataFrame:
    """The expected urls that no chunk cites, in source_url or in source_urls."""
    cited = chunks.select(F.explode(F.array_union(F.array("source_url"), F.coalesce("source_urls", F.array().cast("array<string>")))).alias("url")).filter(F.col("url").isNotNull()).distinct()
    return expected.select("url").distinct().join(cited, "url", "left_anti")


def parity(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side) of keys that only one side has."""
    a, b = left.select(key).dropna().distinct(), right.select(key).dropna().distinct()
    return a.join(b, key, "left_anti").select(key, F.lit("missing").alias("side")).unionByName(b.join(a, key, "left_anti").select(key, F.lit("orphan").alias("side")))


def additive_merge(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, outcome): missing keys added, blank values filled, others kept."""
    both = old.select(key, F.col(value).alias("_old"), F.lit(True).alias("_there")).join(new.select(key, F.col(value).alias("_new")), key, "full_outer")
    filled = F.coalesce(F.nullif(F.col("_old"), F.lit("")), "_new", "_old")
    outcome = F.when(F.col("_there").isNull(), "added").when((F.coalesce("_old", F.lit("")) == "") & (F.coalesce("_new", F.lit("")) != ""), "filled").otherwise("kept")
    return both.select(key, filled.alias(value), outcome.alias("outcome"))


def transfer_plan(listing: DataFrame, state: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, plan): new, updated, unchanged, or gone for keys that only the state has."""
    both = listing.select(key, F.col(digest).alias("_now"), F.lit(1).alias("_l")).join(state.select(key, F.col(digest).alias("_was"), F.lit(1).alias("_s")), key, "full_outer")
    plan = F.when(F.col("_s").isNull(), "new").when(F.col("_l").isNull(), "gone").when(F.col("_now").eqNullSafe(F.col("_was")), "unchanged").otherwise("updated")
    return both.select(key, plan.alias("plan"))


def frontier(edges: DataFrame, seeds: DataFrame, depth: int) -> list[DataFrame]:
    """The nodes first reached at each depth, breadth first. edges: (source, target), read once; seeds: (node). One materialised level per step."""
    from tidemark.plans.materialize import materialize

    levels = [materialize(seeds.select("node", F.lit(0).alias("depth")).distinct(), "level")]
    seen = levels[0].select("node")
    links = materialize(edges.select("source", F.col("target").alias("node")).dropna().distinct(), "links")
    for k in range(1, depth + 1):
        step = links.join(levels[-1].select(F.col("node").alias("source")), "source", "left_semi").select("node").distinct()
        level = materialize(step.join(seen, "node", "left_anti").select("node", F.lit(k).alias("depth")), "level")
        levels.append(level)
        if level.isEmpty():
            break
        seen = seen.unionByName(level.select("node"))
    return levels
