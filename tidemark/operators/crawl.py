"""Crawl policy over manifest rows: URL gates, status classes, merging of outcomes, sweeps, caches and robots rules.

Rules are parameters; decisions are columns, so that a whole frontier is judged in one projection. Network access is an input
table of responses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import urls as U
from tidemark.plans.materialize import small

#: HTTP statuses that exclude a page, and those (beside 5xx and none at all) after which it is tried again (fixed values).
EXCLUDED_STATUS, RETRIED_STATUS = (404, 410, 403, 500, 502, 503), (403, 408, 429)
#: Extensions that are never fetched (fixed values).
SKIPPED_EXTENSIONS = ("jpg", "jpeg", "png", "gif", "svg", "ico", "css", "js", "zip", "mp3", "mp4", "xml", "json")
#: Depth beyond which pages are skipped.
MOST_DEPTH = 6


def allowed(url: Column, exact: list[str], prefixes: list[str]) -> Column:
    """Whether the percent-decoded URL, case ignored, is listed or starts with a listed prefix; false for null."""
    plain = F.lower(F.coalesce(F.try_url_decode(F.replace(url, F.lit("+"), F.lit("%2B"))), url))
    out = plain.isin([e.lower() for e in exact])
    for p in prefixes:
        out = out | plain.startswith(p.lower())
    return F.coalesce(out, F.lit(False))


def exclusion(url: Column, rules: list[tuple[str, str]], exact: list[str] = (), prefixes: list[str] = ()) -> Column:
    """Why a URL stays out, null if it doesn't: empty, no web address, the first rule over its path, a skipped extension, or an old .doc."""
    path = U.part(url, "path")
    extension = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return (
        F.when(F.coalesce(F.trim(url), F.lit("")) == "", "empty").when(allowed(url, list(exact), list(prefixes)), F.lit(None).cast("string"))
        .when(U.first_match(path, rules).isNotNull(), U.first_match(path, rules)).when(extension.isin(*SKIPPED_EXTENSIONS), "file type")
        .when(extension == "doc", "legacy document").when(~F.lower(U.part(url, "scheme")).isin("http", "https"), "no web address")
    )


def status_class(status: Column) -> Column:
    """What an HTTP status means: ok, unchanged, retry, excluded, client (a fault that repeats) or other. No status means retry."""
    return (
        F.when(status.isNull(), "retry").when(status == 304, "unchanged").when(status.between(200, 299), "ok")
        .when((status >= 500) | status.isin(*RETRIED_STATUS), "retry").when(status.isin(*EXCLUDED_STATUS), "excluded").when(status.between(400, 499), "client").otherwise("other")
    )


def repeats(status: Column) -> Column:
    """A client's fault that trying again doesn't mend: 4xx except 408 and 429."""
    return F.coalesce(status.between(400, 499) & ~status.isin(408, 429), F.lit(False))


def gate(depth: Column, excluded: Column, barred: Column, status: Column, internal: Column, present: Column, most_depth: int = MOST_DEPTH) -> Column:
    """The new crawl_status of a frontier row: the first gate that closes decides; a row that was crawled is never demoted."""
    state = (
        F.when(excluded.isNotNull(), "excluded").when(depth > most_depth, "skipped").when(barred, "excluded")
        .when(status_class(status) == "excluded", "excluded").when(status_class(status) == "retry", "failed").when(~internal, "excluded").otherwise("crawled")
    )
    return F.when((present == "crawled") & (state != "crawled"), present).otherwise(state)


def merged_status(present: Column, new: Column) -> Column:
    """The status after another try: what was crawled stays crawled, else the new one where there is one."""
    return F.when(present == "crawled", present).otherwise(F.coalesce(new, present))


def sweep(pages: DataFrame, fetched: DataFrame, failures: int) -> DataFrame:
    """(id, verdict) of the crawled pages (id, url, crawl_status) that a run didn't fetch (url): a case variant of a fetched URL is a duplicate; others are orphans,
    kept if any fetch of the run failed, since their links may stand on the page that wasn't read."""
    left = pages.filter(F.col("crawl_status") == "crawled").join(fetched.select("url").distinct(), "url", "left_anti")
    seen = fetched.select(F.lower("url").alias("_low"), F.lit(True).alias("_seen")).distinct()
    known = left.withColumn("_low", F.lower("url")).join(small(seen), "_low", "left")
    return known.select("id", F.when(F.col("_seen"), "case duplicate").when(F.lit(failures > 0), "kept").otherwise("orphan").alias("verdict"))


def robots_state(responses: DataFrame, tries: int = 3) -> DataFrame:
    """(host, state) from attempts (host, attempt, status): rules after a 2xx, allow after a 4xx, abort if `tries` attempts gave a 5xx or nothing, else retry."""
    s = F.col("status")
    sums = responses.groupBy("host").agg(F.count_if(s.between(200, 299)).alias("ok"), F.count_if(s.between(400, 499)).alias("no"), F.count("*").alias("n"))
    return sums.select("host", F.when(F.col("ok") > 0, "rules").when(F.col("no") > 0, "allow").when(F.col("n") >= tries, "abort").otherwise("retry").alias("state"))


def barred_by_robots(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (id, host, path) with `barred`: of a host's rules (host, prefix, allow) the longest that the path starts with decides, allowing ones on a tie."""
    met = urls.join(rules.withColumnRenamed("host", "_host"), (F.col("host") == F.col("_host")) & F.expr("startswith(path, prefix)"), "left")
    best = met.groupBy("id").agg(F.max(F.struct(F.length("prefix").alias("n"), F.col("allow").cast("int").alias("a"))).alias("best"))
    return urls.join(best, "id", "left").withColumn("barred", F.coalesce(F.col("best.a") == 0, F.lit(False))).drop("best")


def probe(url: Column) -> tuple[Column, Column]:
    """(title, hierarchy) of a document by its address: the file's name without extension, and the folders above it, with spaces for - and _."""
    parts = F.filter(F.split(U.part(url, "path"), "/"), lambda x: x != "")
    spaced = F.transform(parts, lambda x: F.regexp_replace(F.coalesce(F.try_url_decode(x), x), "[-_]+", " "))
    title = F.regexp_replace(F.element_at(spaced, -1), r"\.[^.]*$", "")
    return title, F.slice(spaced, 1, F.greatest(F.size(spaced) - 1, F.lit(0)))


def revalidated(requests: DataFrame, cache: DataFrame, answers: DataFrame) -> DataFrame:
    """(run, url, outcome, version) of each run's first request of a URL; later ones of the run trust it.

    cache (url, version, etag), answers (run, url, status, version): without an entry the answer is fetched; without an etag the entry is
    trusted; 304 keeps it, 2xx replaces it, and any other answer or none leaves the stale copy.
    """
    first = requests.select("run", "url").dropna().distinct()
    both = first.join(cache.select("url", F.col("version").alias("_have"), "etag"), "url", "left").join(answers.select("run", "url", "status", F.col("version").alias("_new")), ["run", "url"], "left")
    good = F.coalesce(F.col("status").between(200, 299), F.lit(False))
    outcome = (
        F.when(F.col("_have").isNull(), F.when(good, "fetched").otherwise("missing")).when(F.col("etag").isNull(), "trusted")
        .when(F.col("status") == 304, "kept").when(good, "replaced").otherwise("stale")
    )
    return both.select("run", "url", outcome.alias("outcome"), F.when(outcome.isin("fetched", "replaced"), F.col("_new")).otherwise(F.col("_have")).alias("version"))


def cache_key(url: Column) -> Column:
    return F.sha2(url, 256)


def purged(entries: DataFrame, fits: Column) -> tuple[DataFrame, DataFrame]:
    """(entries whose content fits their kind, a row with the number of those dropped)."""
    good = F.coalesce(fits, F.lit(False))
    return entries.filter(good), entries.agg(F.count_if(~good).alias("dropped"))


def finished_run(runs: DataFrame, pages: DataFrame, run: Column, at: Column) -> DataFrame:
    """runs with the totals of the manifest and the time of completion in the row of `run`; others stay."""
    s = F.col("crawl_status")
    totals = pages.agg(
        F.count("*").alias("_d"), F.count_if(s == "crawled").alias("_c"), F.count_if(s == "failed").alias("_f"), F.count_if(s == "excluded").alias("_e")
    )
    both = runs.crossJoin(F.broadcast(totals))  # one row
    mine = (F.col("id") == run) & F.col("completed_at").isNull()
    fill = {"total_discovered": "_d", "total_crawled": "_c", "total_failed": "_f", "total_excluded": "_e"}
    out = [F.when(mine, F.col(fill[c]).cast("int")).otherwise(F.col(c)).alias(c) if c in fill else F.when(mine, at).otherwise(F.col(c)).alias(c) if c == "completed_at" else c for c in runs.columns]
    return both.select(*out)


def first_casing(rows: DataFrame, url: str, order: str) -> DataFrame:
    """The rows whose casing of a URL came first; later casings are the same page."""
    w = Window.partitionBy(F.lower(url))
    return rows.filter(F.col(url).isNotNull()).withColumn("_first", F.min_by(url, order).over(w)).filter(F.col("_first") == F.col(url)).drop("_first")
