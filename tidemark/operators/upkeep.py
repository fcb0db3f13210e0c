"""Keeping files, stores and reports in step: listings, plans, drift, verification as one table, vector store writes, versioned copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import corpus
from tidemark.plans.materialize import materialize


class Uncovered(RuntimeError):
    """More of what is expected is missing than a run may go on with."""


def safe_name(name: Column) -> Column:
    """Whether a listed name can be one step of a path."""
    return F.coalesce((F.trim(name) != "") & ~name.isin(".", "..") & ~F.contains(name, F.lit("/")) & ~F.contains(name, F.lit("\\")), F.lit(False))


def local_path(root: str, key: Column) -> Column:
    """Where a key's file goes under root; null for keys that would leave it."""
    steps = F.split(key, "/")
    inside = F.forall(steps, lambda s: safe_name(s)) & ~key.startswith("/")
    return F.when(inside, F.concat(F.lit(root.rstrip("/") + "/"), key))


def fingerprint(size: Column, modified: Column) -> Column:
    return F.concat_ws(":", size.cast("string"), modified.cast("string"))


def intact(content: Column, size: Column, digest: Column) -> Column:
    """Whether bytes have the size and SHA-1 that were announced."""
    return F.coalesce((F.octet_length(content) == size) & (F.sha1(content) == F.lower(digest)), F.lit(False))


def walk(listing: DataFrame, root: int, prefix: str = "", most_depth: int = 32) -> DataFrame:
    """(id, key, depth) of the files under a root folder: listing (id, parent, name, folder) rows are joined level by level.

    Names that are no safe step are left out with what is below them; folders right under the root must start with `prefix`.
    """
    good = listing.filter(safe_name(F.col("name")) & F.col("parent").isNotNull()).select("id", "parent", "name", "folder")
    top = (F.col("parent") == root) & (~F.col("folder") | F.col("name").startswith(prefix))
    level = materialize(good.filter(top).select("id", F.col("name").alias("key"), "folder", F.lit(1).alias("depth")), "walk")
    out = level
    for depth in range(2, most_depth + 1):
        folders = level.filter("folder").select(F.col("id").alias("parent"), F.col("key").alias("_above"))
        below = good.join(folders, "parent").select("id", F.concat_ws("/", "_above", "name").alias("key"), "folder", F.lit(depth).alias("depth"))
        level = materialize(below, "walk")
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out.filter("not folder").select("id", "key", "depth")


def folder_links(pages: DataFrame, html: str, pattern: str) -> DataFrame:
    """(page, id, place): the ids that a page's links name, each once, in the order they first stand."""
    ids = pages.select("page", F.posexplode(F.regexp_extract_all(html, F.lit(pattern), F.lit(1))).alias("pos", "id"))
    first = ids.groupBy("page", "id").agg(F.min("pos").alias("pos"))
    return first.select("page", "id", F.row_number().over(Window.partitionBy("page").orderBy("pos")).alias("place"))


def ingest_plan(files: DataFrame, manifest: DataFrame, state: DataFrame) -> DataFrame:
    """(key, plan): files (key, mark) that the manifest (key, url) gives no URL are skipped; others are new, changed or unchanged against the state (key, mark); state keys without a file are stale."""
    there = files.select("key", F.col("mark").alias("_now"), F.lit(True).alias("_file")).join(manifest.select("key", "url"), "key", "left")
    both = there.join(state.select("key", F.col("mark").alias("_was"), F.lit(True).alias("_saved")), "key", "full_outer")
    plan = (
        F.when(F.col("_file").isNull(), "stale").when(F.coalesce(F.trim("url"), F.lit("")) == "", "skipped").when(F.col("_saved").isNull(), "new")
        .when(F.col("_now").eqNullSafe(F.col("_was")), "unchanged").otherwise("changed")
    )
    return both.select("key", plan.alias("plan"))


def drifted(listing: DataFrame, local: DataFrame) -> DataFrame:
    """(key, drift): what is here but no longer listed, and listed but not here."""
    return corpus.parity(listing, local, "key").select("key", F.when(F.col("side") == "missing", "not here").otherwise("not listed").alias("drift"))


def review_report(decisions: DataFrame) -> DataFrame:
    """(place, line): a report's lines: a heading with the count per decision, and below it the names, sorted. decisions (decision, name)."""
    heads = decisions.groupBy("decision").agg(F.count("*").alias("n")).select("decision", F.lit("").alias("name"), F.format_string("%s (%d)", "decision", "n").alias("line"))
    rows = heads.unionByName(decisions.select("decision", "name", F.concat(F.lit("  "), "name").alias("line")))
    inside = rows.withColumn("_k", F.row_number().over(Window.partitionBy("decision").orderBy("name", "line")))
    # a decision's block starts after those before it, from a table of one row per decision
    sizes = inside.groupBy("decision").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("decision").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("decision", before.alias("_before"))
    return inside.join(F.broadcast(starts), "decision").select((F.col("_before") + F.col("_k")).alias("place"), "line")


def checks(rows: DataFrame, faults: dict[str, Column], warnings: tuple[str, ...] = (), key: str = "chunk_id") -> DataFrame:
    """(check, status, n): one pass over all rows; a check with hits fails, or warns if it is one of `warnings`; skipped if there are no rows."""
    sums = rows.agg(F.count("*").alias("_all"), *[F.count_if(c).alias(n) for n, c in faults.items()])
    each = F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("n"), F.lit(n in warnings).alias("w")) for n in faults])
    flat = sums.select("_all", F.explode(each).alias("c")).select("_all", "c.*")
    status = F.when(F.col("_all") == 0, "SKIPPED").when(F.col("n") == 0, "PASS").when(F.col("w"), "WARN").otherwise("FAIL")
    return flat.select("check", status.alias("status"), "n")


def offenders(rows: DataFrame, faults: dict[str, Column], key: str = "chunk_id", shown: int = 10) -> DataFrame:
    """(check, sample, more): the least `shown` keys of each check's hits, and how many more there are.

    The least keys are kept per task before they are merged, so that no list grows with the hits.
    """
    hits = rows.select(key, F.explode(F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in faults.items()]), lambda x: x.isNotNull())).alias("check")).distinct()
    place = F.row_number().over(Window.partitionBy("check").orderBy(key))
    first = hits.withColumn("_k", place).filter(F.col("_k") <= shown).groupBy("check").agg(F.array_sort(F.collect_list(key)).alias("sample"))
    return first.join(hits.groupBy("check").agg(F.count("*").alias("n")), "check").select("check", F.array_join("sample", " ").alias("sample"), (F.col("n") - F.size("sample")).alias("more"))


def coverage_gate(expected: DataFrame, chunks: DataFrame, most: float = 0.2) -> DataFrame:
    """The uncovered urls; raises Uncovered if they are more than `most` of the expected ones."""
    missing = materialize(corpus.uncovered(expected, chunks), "missing")
    n, whole = missing.count(), expected.select("url").distinct().count()
    if whole and n > most * whole:
        raise Uncovered(f"{n} of {whole} pages have no chunk")
    return missing


def all_chunks(web: DataFrame, files: DataFrame) -> DataFrame:
    """The chunks of the web and of files as one table; columns that one side lacks are null."""
    return web.unionByName(files, allowMissingColumns=True)


def store_vectors(store: DataFrame, new: DataFrame, dimension: int, key: str = "id", order: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(the store with the last of the new rows per key, and a row (stored, failed)): rows without a key or with a vector of another dimension fail by themselves."""
    good = F.col(key).isNotNull() & F.coalesce(F.size("embedding") == dimension, F.lit(False)) & ~F.exists(F.coalesce("embedding", F.array().cast("array<float>")), lambda x: x.isNull() | F.isnan(x))
    counts = new.agg(F.count_if(good).alias("stored"), F.count_if(~good).alias("failed"))
    return corpus.upsert(store, new.filter(good), key, list(order) or [key]), counts


def reclassified(pages: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """(key, old and new class and strategy) of the pages whose class or strategy changes; a change of confidence alone is none."""
    both = pages.select(key, "page_classification", "chunking_strategy", "word_count").join(new.select(key, F.col("page_classification").alias("new_class"), F.col("chunking_strategy").alias("new_strategy")), key)
    return both.filter(~F.col("page_classification").eqNullSafe(F.col("new_class")) | ~F.col("chunking_strategy").eqNullSafe(F.col("new_strategy")))


def numbered_lines(lines: DataFrame, schema: str, value: str = "value") -> DataFrame:
    """lines (file, line_no, value) of JSON with `row` and `fault`: blank lines are left out, a malformed one is named as file:line."""
    there = lines.filter(F.trim(F.coalesce(F.col(value), F.lit(""))) != "")
    parsed = there.withColumn("row", F.from_json(value, f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE"}))
    return parsed.withColumn("fault", F.when(F.col("row").isNull() | F.col("row._corrupt_record").isNotNull(), F.concat_ws(":", "file", F.col("line_no").cast("string"))))


def versioned_copy(table: DataFrame, folder: str, version: str) -> str:
    """Writes a table under a name of its own below `folder`, or nothing if that version is there already; returns its path."""
    spark, path = table.sparkSession, f"{folder.rstrip('/')}/{version}"
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        table.write.mode("overwrite").parquet(path)
    return path
