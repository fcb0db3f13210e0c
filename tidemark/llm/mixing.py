"""Mixing sources to target shares.

The size of the mix is the largest at which every source can reach its share within its cap on repeats. A source's budget is
split into whole rounds over all its documents and a rest that is a subset-sum problem: documents are counted by exact token
length, a first part of the rest is filled with the same fraction of every length, and what then remains, a few times the
longest length at most, by a bounded-knapsack dynamic program over lengths and counts. Which documents of a length are taken
follows from a seeded hash. Lengths and counts up to WINDOW tokens come to the driver, at most WINDOW rows per source.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.conduct import source_name
from tidemark.llm.tokens import count_table
from tidemark.plans.materialize import materialize, small

#: Lengths that the exact fit uses; longer documents are taken in the order of their hash up to their part of the tokens.
WINDOW = 8192
#: Tokens left to the dynamic program at most.
RESIDUE = 60_000
SEED = 7
#: Ranges of hashes over which a hot length is ranked.
RANGES = 4096


def fit_counts(lengths: np.ndarray, counts: np.ndarray, target: int) -> np.ndarray:
    """How many of each length to take so that their sum is `target`, or the greatest reachable below it.

    Bounded knapsack over bit sets: bit s of a state says that s tokens can be reached. Counts are split into powers of two, and
    the states are walked back to find what was taken.
    """
    taken = np.zeros(len(lengths), np.int64)
    if target <= 0 or not len(lengths):
        return taken
    mask = (1 << (target + 1)) - 1
    states, items = [1], []
    order = np.argsort(-counts, kind="stable")
    for i in order:
        left, part = int(min(counts[i], target // lengths[i])), 1
        while left > 0:
            n = min(part, left)
            weight = n * int(lengths[i])
            states.append((states[-1] | (states[-1] << weight)) & mask)
            items.append((i, n, weight))
            left -= n
            part *= 2
        if states[-1] >> target & 1:
            break
    at = states[-1].bit_length() - 1
    for k in range(len(items) - 1, -1, -1):
        i, n, weight = items[k]
        if not states[k] >> at & 1:
            taken[i] += n
            at -= weight
    return taken


def plan_source(lengths: np.ndarray, counts: np.ndarray, long_tokens: int, budget: int) -> np.ndarray:
    """How many documents of each length to use once more, for `budget` tokens, of which long_tokens are spent already."""
    rest = budget - long_tokens
    total = int((lengths * counts).sum())
    if rest <= 0 or total == 0:
        return np.zeros(len(lengths), np.int64)
    if rest >= total:
        return counts.astype(np.int64)
    room = max(0, rest - min(RESIDUE // 2, rest))
    taken = np.floor(counts * (room / total)).astype(np.int64)
    left = rest - int((lengths * taken).sum())
    for i in np.argsort(-lengths, kind="stable"):  # what rounding down left over, longest first
        if left <= RESIDUE:
            break
        n = int(min(counts[i] - taken[i], (left - RESIDUE) // lengths[i] + 1))
        if n > 0:
            taken[i] += n
            left -= n * int(lengths[i])
    while left < 0:
        i = int(np.flatnonzero(taken)[-1])
        n = min(int(taken[i]), -(left // int(lengths[i])))
        taken[i] -= n
        left += n * int(lengths[i])
    return taken + fit_counts(lengths, counts - taken, left)


def _sized(documents: DataFrame, targets: DataFrame, path: str | None) -> DataFrame:
    """(doc_id, source, tokens) of the documents with tokens of the listed sources, materialised."""
    listed = targets.filter(F.col("target_share") > 0).select(F.col("source").alias("listed"))
    rows = documents.filter(F.col("doc_id").isNotNull()).select("doc_id", "text", source_name(F.col("source")).alias("source"))
    rows = rows.join(F.broadcast(listed), F.col("source") == F.col("listed"), "left_semi")
    return materialize(count_table(rows, "doc_id", "text", path, ["source"]).filter("tokens > 0").dropDuplicates(["doc_id"]), "sizes")


def mix(documents: DataFrame, targets: DataFrame, total: int | None = None, seed: int = SEED, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(the mix: doc_id, source, tokens, repeats; the report: source, target_share, actual_share, tokens, documents, most_repeats, max_repeats).

    targets has a row per source (a small table that doesn't grow). total: tokens of the mix; if not given, or more than the
    caps allow, the most that they allow. Sources not listed, without a share or without tokens stay out; documents without
    tokens (null and empty texts) are never used; a doc_id given twice is one document. With no document at all the mix is
    empty and every actual share null.
    """
    wanted = {r["source"]: (float(r["target_share"]), int(r["max_repeats"])) for r in targets.collect() if r["target_share"] and r["max_repeats"]}
    sized = _sized(documents, targets, path)
    have = {r["source"]: (r["t"], r["n"]) for r in sized.groupBy("source").agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).collect()}
    there = {s: v for s, v in wanted.items() if s in have}
    share = sum(v[0] for v in there.values()) or 1.0
    most = min((have[s][0] * v[1] * share / v[0] for s, v in there.items()), default=0)
    size = int(most if total is None else min(total, most))
    budgets = {s: int(round(size * v[0] / share)) for s, v in there.items()}
    rounds = {s: min(there[s][1], budgets[s] // have[s][0]) for s in there}
    rest = {s: budgets[s] - rounds[s] * have[s][0] if rounds[s] < there[s][1] else 0 for s in there}
    spark = documents.sparkSession
    place = F.xxhash64(F.lit(seed), "doc_id")
    plan = [(s, rounds[s], rest[s] / have[s][0] if rest[s] else 0.0) for s in there]
    plans = spark.createDataFrame(plan or [("", 0, 0.0)], "source string, rounds int, fraction double")
    rows = sized.join(F.broadcast(plans), "source").withColumn("place", place)
    # longer documents: in the order of their hash as long as they fit their part of the rest, so that they never go over it;
    # sums per range of hashes first, and only within a range row by row
    long = rows.filter(F.col("tokens") > WINDOW).withColumn("range", F.shiftrightunsigned("place", 64 - 12))
    steps = long.groupBy("source", "range").agg(F.sum("tokens").alias("t"), F.max("fraction").alias("fraction"))
    sofar, whole_source = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("source")
    steps = steps.select("source", "range", F.coalesce(F.sum("t").over(sofar), F.lit(0)).alias("before"), F.floor(F.sum("t").over(whole_source) * F.col("fraction")).alias("quota"))
    inside = F.sum("tokens").over(Window.partitionBy("source", "range").orderBy("place", "doc_id"))
    long = materialize(long.join(steps, ["source", "range"]).withColumn("extra", (F.col("before") + inside <= F.col("quota")).cast("int")), "long")
    spent = {r["source"]: r["t"] for r in long.filter("extra = 1").groupBy("source").agg(F.sum("tokens").alias("t")).collect()}
    short = rows.filter(F.col("tokens") <= WINDOW)
    table = short.filter("fraction > 0").groupBy("source", "tokens").agg(F.count("*").alias("n")).toPandas()
    chosen = []
    for s, part in table.groupby("source"):
        part = part.sort_values("tokens")
        lengths, counts = part["tokens"].to_numpy(np.int64), part["n"].to_numpy(np.int64)
        taken = plan_source(lengths, counts, spent.get(s, 0), rest[s])
        chosen += [(s, int(n), int(k)) for n, k in zip(lengths, taken) if k]
    picked = spark.createDataFrame(chosen or [("", 0, 0)], "source string, tokens bigint, take bigint")
    # ranks within a length, by ranges of the hash: counts per range first, and only the range at the edge is ranked row by row
    hot = short.withColumn("range", F.shiftrightunsigned("place", 64 - 12)).join(F.broadcast(picked), ["source", "tokens"], "left")
    ranges = hot.filter("take > 0").groupBy("source", "tokens", "range").agg(F.count("*").alias("n"))
    before = ranges.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("source", "tokens").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    edges = before.select("source", "tokens", "range", "before")
    placed = hot.join(edges, ["source", "tokens", "range"], "left")
    rank = F.row_number().over(Window.partitionBy("source", "tokens", "range").orderBy("place", "doc_id"))
    short = placed.withColumn("extra", F.coalesce((F.col("before") + rank <= F.col("take")).cast("int"), F.lit(0)))
    columns = ["doc_id", "source", "tokens", (F.col("rounds") + F.col("extra")).cast("int").alias("repeats")]
    mixed = long.select(*columns).unionByName(short.select(*columns)).filter("repeats > 0")
    mixed = materialize(mixed, "mix")
    sums = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.count("*").alias("documents"), F.max("repeats").alias("most_repeats"))
    whole = sums.agg(F.sum("tokens").alias("whole"))
    report = targets.select("source", "target_share", "max_repeats").join(F.broadcast(sums), "source", "left").crossJoin(F.broadcast(whole)).select(
        "source", "target_share", (F.coalesce("tokens", F.lit(0)) / F.col("whole")).alias("actual_share"), F.coalesce("tokens", F.lit(0)).alias("tokens"),
        F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), "max_repeats",
    )
    return mixed, report
