"""The request side of an assistant as stages over a table of requests: validation, a category gate with canned answers, retrieval,
answers, checks, costs and logs. Models are callables over Arrow batches that the caller supplies; what fails is a row, not an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import requests as R

#: Limits of a request (fixed values).
MOST_USER, MOST_QUERY = 128, 2000
#: Messages of history, and characters of each, that a classifier sees.
CONTEXT_MESSAGES, CONTEXT_CHARS = 4, 600


def invalid(user: Column, query: Column) -> Column:
    """Why a request is refused, null if it isn't: its user id (1 to 128 letters, digits, _ and -) or its query (1 to 2000 characters)."""
    return (
        F.when(~F.coalesce(user.rlike(rf"^[A-Za-z0-9_-]{{1,{MOST_USER}}}$"), F.lit(False)), "user_id")
        .when(~F.coalesce(F.length(query).between(1, MOST_QUERY), F.lit(False)), "query")
    )


def outcome(category: Column, error: Column, passing: list[str]) -> Column:
    """The bucket of a request: error:<kind>, blocked:<category>, or ok."""
    return F.when(error.isNotNull(), F.concat(F.lit("error:"), error)).when(category.isin(passing), "ok").otherwise(F.concat(F.lit("blocked:"), F.coalesce(category, F.lit("unclassified"))))


def by_model(rows: DataFrame, call: Callable[[list[str]], list[str | None]], text: str, out: str, retries: int = 0, fallback: str | None = None) -> DataFrame:
    """rows with `out`, what the model makes of `text`; a batch that fails is tried `retries` more times and then falls back, a null answer falls back too."""
    names = rows.columns
    place = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found = batch.column(place).to_pylist(), None
            for _ in range(retries + 1):
                try:
                    found = call(texts)
                    break
                except Exception:  # the model's fault; the last one falls back
                    found = None
            found = [fallback] * len(texts) if found is None else [fallback if x is None else x for x in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], [*names, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{schema}, `{out}` string")


def gated(rows: DataFrame, classify: Callable, canned: dict[str, str], passing: list[str], text: str = "query", tag: str | None = None) -> DataFrame:
    """rows with `category` and `canned`: what isn't passing gets its canned answer, unknown categories and failures that of `unclassified`.

    A query that starts with `tag` passes as the first passing category without the model.
    """
    tagged = rows.withColumn("_tagged", F.coalesce(F.startswith(text, F.lit(tag)), F.lit(False)) if tag else F.lit(False))
    told = by_model(tagged, classify, text, "_told", fallback="unclassified")
    known = [*passing, *canned]
    category = F.when(F.col("_tagged"), passing[0]).when(F.col("_told").isin(known), F.col("_told")).otherwise("unclassified")
    answers = F.create_map(*[x for pair in canned.items() for x in map(F.lit, pair)])
    return told.withColumn("category", category).withColumn("canned", F.try_element_at(answers, F.col("category"))).drop("_tagged", "_told")


def answered(rows: DataFrame, generate: Callable, partial_to: Callable, retries: int = 2, safe: str = "") -> DataFrame:
    """rows (prompt) with `answer`: an answer that the check marks (`yes`, or the check's failure) is made anew, at most `retries` times, and then is `safe`.

    Each round goes over the marked rows only.
    """
    done = None
    left = rows
    for _ in range(retries + 1):
        tried = by_model(by_model(left, generate, "prompt", "answer", fallback=safe), partial_to, "answer", "_marked", fallback="yes")
        good = tried.filter("_marked = 'no'").drop("_marked")
        done = good if done is None else done.unionByName(good)
        left = tried.filter("_marked <> 'no'").drop("_marked", "answer")
    return done.unionByName(left.withColumn("answer", F.lit(safe)))


def chat(requests: DataFrame, classify: Callable, retrieve: Callable[[DataFrame], DataFrame], generate: Callable, check: Callable, canned: dict[str, str], passing: list[str], safe: str) -> DataFrame:
    """(id, outcome, answer) of requests (id, user_id, query): refused, canned or generated from retrieved context and checked.

    retrieve takes the passing requests and gives (id, context); a request without context goes on with an empty one.
    """
    judged = requests.withColumn("error", invalid(F.col("user_id"), F.col("query")))
    refused = judged.filter("error is not null").select("id", outcome(F.lit(None).cast("string"), F.col("error"), passing).alias("outcome"), F.lit(None).cast("string").alias("answer"))
    routed = gated(judged.filter("error is null").drop("error"), classify, canned, passing)
    blocked = routed.filter(~F.col("category").isin(passing)).select("id", outcome(F.col("category"), F.lit(None).cast("string"), passing).alias("outcome"), F.col("canned").alias("answer"))
    going = routed.filter(F.col("category").isin(passing)).select("id", "query")
    prompts = going.join(retrieve(going), "id", "left").select("id", F.concat_ws("\n", F.coalesce("context", F.lit("")), "query").alias("prompt"))
    made = answered(prompts, generate, check, safe=safe).select("id", F.lit("ok").alias("outcome"), R.without_markers(F.col("answer")).alias("answer"))
    return refused.unionByName(blocked).unionByName(made)


def classifier_input(history: DataFrame, key: str, order: list[str], role: Column, text: Column, chars: int = CONTEXT_CHARS, messages: int = CONTEXT_MESSAGES) -> DataFrame:
    """(key, context): the last messages of each key under their roles, oldest first, each cut to `chars` characters and an ellipsis.

    Of each key only its last messages are kept before anything is gathered.
    """
    last = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    short = F.when(F.length(text) > chars, F.concat(F.substring(text, 1, chars), F.lit("…"))).otherwise(text)
    rows = history.withColumn("_k", F.row_number().over(last)).filter(F.col("_k") <= messages).select(key, "_k", F.concat(role, F.lit(": "), short).alias("_m"))
    ordered = F.reverse(F.array_sort(F.collect_list(F.struct("_k", "_m"))))
    return rows.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["_m"]), "\n").alias("context"))


def priced(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """calls (model, ...) with `price`: that of the model's name, else of the first entry (ord) that its name starts with, else 0. prices (name, price, ord) is a small table."""
    models = calls.select("model").distinct()
    met = models.join(F.broadcast(prices), F.expr("startswith(model, name)"), "left")
    best = met.groupBy("model").agg(F.min_by("price", F.struct((F.col("name") != F.col("model")).alias("a"), F.col("ord"))).alias("price"))
    return calls.join(best, "model", "left").withColumn("price", F.coalesce("price", F.lit(0.0)))


def two_limits(rows: DataFrame, key: str, at: str, order: str, limit: int, whole: int, seconds: float) -> DataFrame:
    """(order, key, verdict): `user` or `global` for the limit that rejects, else `accepted`. A request that the global limit rejects has used up its user's slot.

    The first stage runs per key in parallel. The second is a fold over all accepted requests in order of time, streamed with a
    state of at most `whole` times: a limit over everything is one sequence, which no partitioning can divide.
    """
    first = R.limit_decisions(rows, key, at, order, limit, seconds)
    both = rows.select(order, at).join(first, order)
    passed = both.filter("accepted").withColumn("_all", F.lit(0))
    second = R.limit_decisions(passed, "_all", at, order, whole, seconds).select(order, F.col("accepted").alias("_ok"))
    out = both.join(second, order, "left")
    return out.select(order, key, F.when(~F.col("accepted"), "user").when(~F.col("_ok"), "global").otherwise("accepted").alias("verdict"))


def throttled(rows: DataFrame, key: str, at: str, order: str, seconds: float = 60) -> DataFrame:
    """(order, key, suppressed): the messages that are logged, at most one per key and span, with how many were held back since the one before."""
    told = R.limit_decisions(rows, key, at, order, 1, seconds).join(rows.select(order, at), order)
    w = Window.partitionBy(key).orderBy(at, order)
    numbered = told.withColumn("_n", F.row_number().over(w)).filter("accepted")
    return numbered.select(order, key, (F.col("_n") - F.coalesce(F.lag("_n").over(w), F.lit(0)) - 1).alias("suppressed"))


def swept_sessions(sessions: DataFrame, ticks: DataFrame, silence: int) -> DataFrame:
    """(key, session, gone_at): the first tick of the sweep after a session's silence; null while none has come. ticks (at) is a small table."""
    due = sessions.join(F.broadcast(ticks), F.col("at") > F.col("ended") + F.make_interval(secs=F.lit(silence)), "left")
    return due.groupBy(*sessions.columns).agg(F.min("at").alias("gone_at"))


def pruned_callbacks(events: DataFrame, key: str, at: str, opens: Column, closes: Column, age: int = 600) -> DataFrame:
    """(key, state) per callback: closed within `age` seconds, pruned if not, open if younger than that at the last event of all."""
    spans = events.groupBy(key).agg(F.min(F.when(opens, F.col(at))).alias("a"), F.max(F.when(closes, F.col(at))).alias("b"))
    end = events.agg(F.max(at).alias("z"))
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    limit = age * 1_000_000
    state = F.when(us("b") - us("a") <= limit, "closed").when(us("z") - us("a") > limit, "pruned").otherwise("open")
    return spans.filter("a is not null").crossJoin(F.broadcast(end)).select(key, state.alias("state"))  # one row


def retrieved(title: Column, text: Column, score: Column, url: Column, urls: Column) -> Column:
    """A retrieved row as a document: defaults for what is missing, the score rounded, its distinct known URLs, or else its own."""
    known = F.filter(F.array_distinct(F.coalesce(urls, F.array().cast("array<string>"))), lambda u: u.isNotNull() & (u != "unknown") & (u != ""))
    mine = F.coalesce(url, F.lit("unknown"))
    return F.struct(
        F.coalesce(title, F.lit("unknown")).alias("title"), F.coalesce(text, F.lit("")).alias("text"), F.round(score, 4).alias("score"), mine.alias("url"),
        F.when(F.size(known) > 0, known).otherwise(F.array(mine)).alias("urls"),
    )


def numbered_sources(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """rows with `source_number`, 1 for the first of its key."""
    return rows.withColumn("source_number", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def link_list(sources: Column, empty: str) -> Column:
    """Cached sources (array of struct title, url) as a list of links, each URL once; a fixed message without any."""
    there = F.filter(F.coalesce(sources, F.array().cast("array<struct<title:string,url:string>>")), lambda s: s["url"].isNotNull() & (s["url"] != ""))
    first = F.filter(there, lambda s, i: F.array_position(F.transform(there, lambda t: t["url"]), s["url"]) == i + 1)
    lines = F.transform(first, lambda s: F.concat(F.lit("- ["), F.coalesce(s["title"], s["url"]), F.lit("]("), s["url"], F.lit(")")))
    return F.when(F.size(first) == 0, F.lit(empty)).otherwise(F.array_join(lines, "\n"))


def without_tag(text: Column, tag: str) -> Column:
    """A message without a marking tag, wherever it stands."""
    return F.trim(F.replace(text, F.lit(tag), F.lit("")))


def template_safe(text: Column) -> Column:
    """Braces doubled, so that a template takes them as they are."""
    return F.replace(F.replace(text, F.lit("{"), F.lit("{{")), F.lit("}"), F.lit("}}"))


def like_safe(text: Column) -> Column:
    """A string for LIKE ... ESCAPE '!' in which nothing is a wildcard."""
    for sign in "!%_":
        text = F.replace(text, F.lit(sign), F.lit("!" + sign))
    return text


def log_line(user: Column, outcome_: Column, text: Column, raw: bool = False) -> Column:
    """A request's log line; the text itself only if opted in, else its length."""
    shown = text if raw else F.concat(F.lit("<"), F.coalesce(F.length(text), F.lit(0)).cast("string"), F.lit(" chars>"))
    return F.concat_ws(" ", F.concat(F.lit("user="), F.sha2(user.cast("string"), 256).substr(1, 12)), F.concat(F.lit("outcome="), outcome_), F.concat(F.lit("text="), shown))


def gold_matches(texts: DataFrame, specs: DataFrame) -> DataFrame:
    """(item, id) of the texts (id, url, text) that meet any of an item's specs (item, url, pattern): the URL contains one's url and the text its pattern; nulls in a spec always do.

    specs is a small table.
    """
    fits = (F.col("s.url").isNull() | F.contains(F.col("t.url"), F.col("s.url"))) & (F.col("s.pattern").isNull() | F.expr("t.text rlike s.pattern"))
    return texts.alias("t").join(F.broadcast(specs).alias("s"), fits).select("s.item", "t.id").distinct()


def drift(results: DataFrame, keys: list[str], expected: str, runs: list[str]) -> DataFrame:
    """Counts of an evaluation: per run what differs from the expected value, and how often the first two runs differ from each other."""
    wrong = [F.count_if(~F.col(r).eqNullSafe(F.col(expected))).alias(f"wrong_{r}") for r in runs]
    return results.groupBy(*keys).agg(F.count("*").alias("n"), *wrong, F.count_if(~F.col(runs[0]).eqNullSafe(F.col(runs[1]))).alias("drift"))
