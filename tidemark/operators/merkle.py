"""Incremental processing by comparison of Merkle trees.

A tree covers the key space by ranges of a 64-bit hash of the key: level 0 is the root, each level has FANOUT times the
nodes of the one above, and a leaf holds the keys whose hash falls into its range. A leaf's digest combines the hashes of
its (key, digest) rows by exclusive or and sum, so that it is computed with partial aggregation and without an order; an
inner node's digest is SHA-256 over its children's digests. Two trees are compared from the root down, and only below
nodes whose digests differ; rows are looked at only in leaves that differ.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.materialize import materialize, own_folder, small

#: Children of an inner node, as a power of two.
FANOUT_BITS = 4
#: Rows that a leaf should hold on average.
LEAF_ROWS = 64
#: Levels below the root at most: 16**7 leaves of 64 rows are 1.7e10 rows.
MAX_DEPTH = 7
#: Versions whose rows a state may be spread over; then all rows are written together again.
MOST_PARTS = 8


def normal_digest(column: Column) -> Column:
    """A content hash without letter case, surrounding space and line ends and a leading `sha256:`; null for null and empty."""
    bare = F.regexp_replace(F.lower(column), r"^\s*(sha256:)?\s*|\s+$", "")
    return F.when(bare != "", bare)


def latest(rows: DataFrame, key: str, at: str, keep: list[str]) -> DataFrame:
    """The row with the latest `at` of each key (null is earliest; ties fall to the greatest values of `keep`, nulls least).

    One partial aggregation; rows without a key are left out, repeated rows count once.
    """
    values = F.struct(F.col(at).alias("at"), *[F.col(c).alias(c) for c in keep])
    best = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(values).alias("best"))
    return best.select(key, *[F.col(f"best.{c}").alias(c) for c in keep])


def depth_for(rows: int) -> int:
    """Levels below the root so that leaves hold about LEAF_ROWS rows."""
    depth = 0
    while depth < MAX_DEPTH and LEAF_ROWS << (FANOUT_BITS * depth) < rows:
        depth += 1
    return depth


def leaf_of(key: Column, depth: int) -> Column:
    """The number of the leaf whose key range holds the key."""
    bits = FANOUT_BITS * depth
    return F.shiftrightunsigned(F.xxhash64(key), 64 - bits) if bits else F.lit(0).cast("bigint")


def leaves(rows: DataFrame, key: str, digests: dict[str, str], depth: int) -> DataFrame:
    """A row per leaf, with a digest column per entry of `digests` (name -> column); keys with a null digest are not in that tree."""
    parts = []
    for name, column in digests.items():
        there = F.col(column).isNotNull()
        one, two = F.xxhash64(F.col(key), F.col(column)), F.xxhash64(F.col(column), F.lit(1), F.col(key))
        parts += [
            F.bit_xor(F.when(there, one)).alias(f"{name}_x"),
            F.bit_xor(F.when(there, two)).alias(f"{name}_y"),
            F.count(F.when(there, 1)).alias(f"{name}_n"),
        ]
    table = rows.groupBy(leaf_of(F.col(key), depth).alias("node")).agg(*parts)
    return table.select("node", *[F.when(F.col(f"{n}_n") > 0, F.sha2(F.concat_ws(":", f"{n}_x", f"{n}_y", f"{n}_n"), 256)).alias(n) for n in digests])


def levels(bottom: DataFrame, names: list[str], depth: int) -> list[DataFrame]:
    """The tables (node, digest columns) of each level, root first. A parent hashes at most 2**FANOUT_BITS children."""
    out = [bottom]
    for _ in range(depth):
        below = out[0]
        up = below.groupBy(F.shiftright("node", FANOUT_BITS).alias("node")).agg(
            *[F.array_sort(F.collect_list(F.when(F.col(n).isNotNull(), F.concat_ws(":", F.col("node").cast("string"), F.col(n))))).alias(n) for n in names]
        )
        out.insert(0, up.select("node", *[F.when(F.size(n) > 0, F.sha2(F.array_join(n, ","), 256)).alias(n) for n in names]))
    return out


def differing_leaves(tree: list[DataFrame], now: str = "now", saved: str = "saved") -> DataFrame:
    """The leaves at which the trees differ, found from the root down; a level's nodes are read only below nodes that differ."""
    frontier = tree[0].filter(~F.col(now).eqNullSafe(F.col(saved))).select("node")
    for level in tree[1:]:
        parents = frontier.select(F.col("node").alias("parent"))
        unlike = level.filter(~F.col(now).eqNullSafe(F.col(saved)))
        frontier = unlike.join(parents, F.shiftright(unlike["node"], FANOUT_BITS) == parents["parent"], "left_semi").select("node")
    return frontier


def _content(pages: DataFrame) -> DataFrame:
    """(id, h_now, h_saved) of the latest row of each page; h_now only of crawled ones."""
    last = latest(pages, "id", "crawled_at", ["crawl_status", "content_hash", "previous_content_hash"])
    return last.select(
        "id", F.when(F.col("crawl_status") == "crawled", normal_digest(F.col("content_hash"))).alias("h_now"), normal_digest(F.col("previous_content_hash")).alias("h_saved")
    )


def changed_pages(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """page_id of the pages to hand on: the latest row of each id was crawled, and its content hash is new or differs from what the last completed run processed.

    folder holds the runs' state; where it has none yet, or isn't given, the state that the last completed run left is taken over
    from previous_content_hash. The rows are what the run then publishes as its output. Null and empty hashes: a page without
    content_hash is never handed on; one without a saved hash always is. Repeated and late rows count once; an empty table gives no
    row; other columns don't matter.
    """
    spark = pages.sparkSession
    last = materialize(_content(pages), "content")
    run = IncrementalRun(spark, folder or own_folder(spark, "runs"))
    if run.current() is None:
        run.run(last.filter(F.col("h_saved").isNotNull()), "id", "h_saved", None)
    record = run.run(last.filter(F.col("h_now").isNotNull()).select("id", "h_now"), "id", "h_now", lambda todo: todo.select(F.col("id").alias("page_id")))
    return spark.read.schema(f"page_id {last.schema['id'].dataType.simpleString()}").parquet(f"{record['path']}/output")


class Superseded(RuntimeError):
    """Another run published a version since this one read the state; nothing of this one is in force, and it may be run again."""


class IncrementalRun:
    """Runs that process each record that is new or changed since the last completed run once.

    `folder` holds a folder per run, and in `versions` one file per published version, named by its number. A run's folder has the
    output, the keys that are gone, a row per leaf of the tree (its digest, and the version that holds its rows) and the
    (key, digest) rows of the leaves that changed. A run compares its own tree with the saved one from the root down, reads saved rows
    only of leaves that differ, writes its folder in full, and then creates the next version's file, which fails if there is one:
    output and tree are published together or not at all, and of two runs at once one is told that it is superseded. A run that
    fails before leaves the last version in force, so that the next run sees the same changes again.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def current(self) -> dict | None:
        """The last published version's record, or None before the first run."""
        there = self._path(f"{self.folder}/versions")
        if not self._fs.exists(there):
            return None
        names = sorted(n for f in self._fs.listStatus(there) if (n := f.getPath().getName()).isdigit())
        if not names:
            return None
        stream = self._fs.open(self._path(f"{self.folder}/versions/{names[-1]}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _publish(self, record: dict) -> None:
        target = self._path(f"{self.folder}/versions/{record['version']:08d}")
        part = self._path(f"{self.folder}/versions/part-{uuid.uuid4().hex}")
        stream = self._fs.create(part, True)
        stream.write(bytearray(json.dumps(record).encode()))
        stream.close()
        jvm, configuration = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(part.toUri() if part.toUri().getScheme() else self._fs.getUri(), configuration)
        keep = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        keep[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(part, target, keep)
        except Exception as e:
            self._fs.delete(part, False)
            if self._fs.exists(target):
                raise Superseded(f"version {record['version']} was published by another run") from e
            raise

    def _saved_rows(self, before: dict, leaves_: DataFrame, kind: str) -> DataFrame:
        """(key, digest, node) of the saved rows of the given leaves (node, home)."""
        rows = self.spark.read.schema(f"key {kind}, digest string, node bigint, home int").parquet(*[f"{p}/rows" for p in before["parts"]])
        return rows.join(leaves_.select("node", "home"), ["node", "home"], "left_semi").select("key", "digest", "node")

    def run(self, records: DataFrame, key: str, digest: str, process: Callable[[DataFrame], DataFrame] | None) -> dict:
        """Process the records (key unique, digest not null) that are new or changed; returns the published record.

        Without `process` the records' state is taken over and nothing is processed. The record names the run's folder (path), the
        rows processed (changed) and the keys gone since (removed, listed in `path`/removed).
        """
        before = self.current()
        version = (before["version"] if before else 0) + 1
        target = f"{self.folder}/v{version:08d}-{uuid.uuid4().hex[:8]}"
        try:
            record = self._write(records, key, digest, process, before, version, target)
            self._publish(record)
        except BaseException:
            self._fs.delete(self._path(target), True)
            raise
        return record

    def _write(self, records: DataFrame, key: str, digest: str, process, before: dict | None, version: int, target: str) -> dict:
        kind = records.schema[key].dataType.simpleString()
        pairs = materialize(records.select(F.col(key).alias("key"), F.col(digest).alias("digest")), "pairs")
        n = pairs.count()
        depth = depth_for(n)
        if before and depth <= before["depth"]:
            depth = before["depth"]
        pairs = pairs.withColumn("node", leaf_of(F.col("key"), depth))
        bottom = materialize(leaves(pairs, "key", {"now": "digest"}, depth), "leaves")
        was = pairs.select("key", "digest", "node").limit(0)
        if before:
            kept = self.spark.read.schema("node bigint, saved string, home int").parquet(f"{before['path']}/leaves")
            if before["depth"] < depth:  # the tree has grown: its leaves are made anew from the saved rows
                was = self._saved_rows(before, kept, kind).withColumn("node", leaf_of(F.col("key"), depth))
                kept = leaves(was, "key", {"saved": "digest"}, depth).withColumn("home", F.lit(version))
            tree = levels(materialize(bottom.join(kept, "node", "full_outer").select("node", "now", "saved"), "tree"), ["now", "saved"], depth)
            unlike = materialize(differing_leaves(tree), "unlike")
            if before["depth"] == depth:
                was = self._saved_rows(before, kept.join(unlike, "node", "left_semi"), kind)
            else:
                was = was.join(unlike, "node", "left_semi")
            was = materialize(was, "saved")
            new = pairs.join(unlike, "node", "left_semi")
        else:
            new = pairs
        whole = not before or before["depth"] < depth or len(before["parts"]) >= MOST_PARTS
        changed = 0
        if process is not None:
            fresh = materialize(new.join(was, ["key", "digest"], "left_anti").select("key"), "fresh")
            changed = fresh.count()
            process(records.join(small(fresh, changed), records[key] == fresh["key"], "left_semi")).write.parquet(f"{target}/output")
        was.join(new, "key", "left_anti").select("key").write.parquet(f"{target}/removed")
        (pairs if whole else new).select("key", "digest", "node", F.lit(version).alias("home")).write.parquet(f"{target}/rows")
        mine = bottom.select("node", F.col("now").alias("saved"), F.lit(version).alias("home"))
        if not whole:
            mine = mine.join(unlike, "node", "left_semi").unionByName(kept.join(unlike, "node", "left_anti").select("node", "saved", "home"))
        mine.write.parquet(f"{target}/leaves")
        removed = self.spark.read.schema(f"key {kind}").parquet(f"{target}/removed").count()
        parts = [target] if whole else [*before["parts"], target]
        return {"version": version, "path": target, "depth": depth, "records": n, "changed": changed, "removed": removed, "parts": parts, "at": time.time()}
