"""Queries of vectors and requests, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import requests as R
from tidemark.operators import vectors as V
from tidemark.sources.tables import table


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = _vectors(spark, d)
    return V.top_k(rows, rows.filter("id % 100 = 0")).select("query", "id", "rank", F.round("score", 4).alias("score"))


def vector_topk_penalty(spark: SparkSession, d: str) -> DataFrame:
    rows = _vectors(spark, d).withColumn("less", F.when(F.col("label") % 2 == 1, 0.02).otherwise(0.0))
    return V.top_k(rows, rows.filter("id % 100 = 0"), penalty="less").select("query", "id", "rank", F.round("score", 4).alias("score"))


def vector_floor(spark: SparkSession, d: str) -> DataFrame:
    rows = _vectors(spark, d)
    return V.top_k(rows, rows.filter("id % 100 = 0"), k=10, floor=0.5).select("query", "id", "rank")


def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    rows = _vectors(spark, d)
    ranked = V.top_k(rows, rows.filter("id % 100 = 0"), k=11).filter("query <> id").withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("rank")))
    labels = rows.select("id", "label")
    both = ranked.filter("rank <= 10").join(labels, "id").join(F.broadcast(labels.filter("id % 100 = 0").select(F.col("id").alias("query"), F.col("label").alias("wanted"))), "query")
    out = V.retrieval_metrics(both.withColumn("good", F.col("label") == F.col("wanted")), "good", "wanted")
    return out.select(F.coalesce("wanted", F.lit(-1)).alias("segment"), "n", *[F.round(c, 6).alias(c) for c in ("hit_1", "hit_k", "mrr", "p_k")])


def rate_limit_decisions(spark: SparkSession, d: str) -> DataFrame:
    return R.limit_decisions(table(spark, d, "events"), "user_id", "ts", "event_id", limit=3, seconds=6 * 3600)


def sliding_request_rate(spark: SparkSession, d: str) -> DataFrame:
    return R.sliding_rate(table(spark, d, "events"), "user_id", "ts", 3600).select("event_id", "rate")


def sessions(spark: SparkSession, d: str) -> DataFrame:
    return R.sessions(table(spark, d, "events"), "user_id", "ts").select("user_id", "session", "started", "ended", "requests")


def heartbeat_5m(spark: SparkSession, d: str) -> DataFrame:
    return R.heartbeat(table(spark, d, "events"), "ts", "event_type").select(F.unix_seconds("start").alias("start"), "requests", "errors")


def cumulative_totals(spark: SparkSession, d: str) -> DataFrame:
    return R.heartbeat(table(spark, d, "events"), "ts", "event_type", "1 day").select(F.unix_seconds("start").alias("start"), "all_requests", "all_errors")


def last_sources(spark: SparkSession, d: str) -> DataFrame:
    return R.last_known(table(spark, d, "events"), "user_id", "ts", F.when(F.col("event_type") == "view", F.col("props")), "event_id")


def history_trim(spark: SparkSession, d: str) -> DataFrame:
    """The last 40 messages of each user."""
    order = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, d, "events").withColumn("k", F.row_number().over(order)).filter("k <= 40").select("event_id", "user_id", "k")


def classifier_context(spark: SparkSession, d: str) -> DataFrame:
    """The last four messages of each user, cut to 12 characters, under their roles."""
    message = F.concat(F.when(F.col("event_type") == "view", "User: ").otherwise("Assistant: "), F.when(F.length("props") > 8, F.concat(F.substring("props", 1, 8), F.lit("…"))).otherwise(F.col("props")))
    order = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    last = table(spark, d, "events").withColumn("k", F.row_number().over(order)).filter("k <= 4").select("user_id", "k", message.alias("m"))
    return last.groupBy("user_id").agg(F.array_join(F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("k", "m")))), lambda x: x["m"]), "\n").alias("context"))


def stage_timings(spark: SparkSession, d: str) -> DataFrame:
    """Seconds per user and stage, in the order of stages; a stage's repeats add up."""
    stages = ["signup", "view", "click", "purchase"]
    sums = table(spark, d, "events").groupBy("user_id").pivot("event_type", stages).agg(F.round(F.sum("value"), 2))
    line = F.concat_ws(" ", *[F.when(F.col(s).isNotNull(), F.concat(F.lit(f"{s}="), F.format_string("%.2f", s))) for s in stages])
    return sums.select("user_id", line.alias("line"))


def personal_data(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy(R.personal_data(F.col("text")).alias("kind")).agg(F.count("*").alias("n"))


#: Questions as users ask them, and whether they speak of links and ask for them.
QUESTIONS = [
    ("Can you send me the links?", True, True), ("could you please share your sources with us", True, True), ("What's the URL?", True, True), ("what are the sources", True, True), ("Sources, please", True, True),
    ("the links please", True, True), ("Would you resend it? And the citations", True, True), ("thanks, I don't need the links", True, False), ("Can you answer without giving sources?", True, False),
    ("no links please", True, False), ("what did you mean by that reference?", True, False), ("Could you not send any urls", True, False), ("Can you tell me where to vote?", False, False), ("When is the office open?", False, False),
    ("I like linking arms. Please stay", False, False),
]


def link_intent(spark: SparkSession, d: str) -> DataFrame:
    """Documents by a question dealt to each, and what is understood of it."""
    asked = F.element_at(F.array(*[F.lit(q) for q, _, _ in QUESTIONS]), (F.col("doc_id") % len(QUESTIONS) + 1).cast("int"))
    rows = table(spark, d, "documents").select(asked.alias("question"))
    return rows.groupBy("question", R.wants_links(F.col("question")).alias("wants"), R.asks_for_links(F.col("question")).alias("asks")).agg(F.count("*").alias("n"))


def link_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose text speaks of links, sources or citations."""
    return table(spark, d, "documents").select("doc_id", R.wants_links(F.col("text")).alias("wants"))


def strip_source_markers(spark: SparkSession, d: str) -> DataFrame:
    marked = F.concat_ws("", F.coalesce("title", F.lit("x")), F.lit(" [Source 1, Source 2] and  more [source: none] [text](url)"))
    return table(spark, d, "chunks").select("chunk_id", R.without_markers(marked).alias("text")).distinct()


QUERIES = {
    f.__name__: f
    for f in (
        vector_topk, vector_topk_penalty, vector_floor, retrieval_metrics, rate_limit_decisions, sliding_request_rate, sessions, heartbeat_5m, cumulative_totals, last_sources, history_trim, classifier_context, stage_timings,
        personal_data, link_intent, link_mentions, strip_source_markers,
    )
}

_SIM = "list_cosine_similarity(q.embedding::double[], e.embedding::double[])"
_RANK = """with s as (select q.vec_id as query, e.vec_id as id, e.label, q.label as wanted, {sim} as score, {sim} - {less} as key from embeddings q, embeddings e where q.vec_id % 100 = 0 {more}),
    r as (select *, row_number() over (partition by query order by round(key, 12) desc, id) as rank from s)"""
_SQL_RANK = _RANK.format(sim=_SIM, less="0", more="")
SQL = {
    "vector_topk": _SQL_RANK + " select query, id, rank::int as rank, round(score, 4) as score from r where rank <= 5",
    "vector_topk_penalty": _RANK.format(sim=_SIM, less="case when e.label % 2 = 1 then 0.02 else 0 end", more="") + " select query, id, rank::int as rank, round(score, 4) as score from r where rank <= 5",
    "vector_floor": _SQL_RANK + " select query, id, rank::int as rank from r where rank <= 10 and score >= 0.5",
    "retrieval_metrics": _RANK.format(sim=_SIM, less="0", more="and q.vec_id <> e.vec_id") + """,
        f as (select wanted, query, min(rank) filter (label = wanted) as first, count(*) filter (label = wanted and rank <= 5) as good from r where rank <= 10 group by wanted, query)
        select coalesce(wanted, -1) as segment, count(*) as n, round(avg(coalesce((first = 1)::int, 0)), 6) as hit_1, round(avg(coalesce((first <= 5)::int, 0)), 6) as hit_k, round(avg(coalesce(1.0 / first, 0)), 6) as mrr, round(sum(good) / (count(*) * 5.0), 6) as p_k
        from f group by grouping sets ((wanted), ())""",
    "rate_limit_decisions": """
        with recursive e as (select event_id, user_id, epoch_us(ts) as us, row_number() over (partition by user_id order by ts, event_id) as i from events where user_id is not null and ts is not null),
        f as (
            select event_id, user_id, i, true as accepted, [us] as held from e where i = 1
            union all
            select e.event_id, e.user_id, e.i, len(list_filter(f.held, lambda t: e.us - t < 21600000000)) < 3,
                   case when len(list_filter(f.held, lambda t: e.us - t < 21600000000)) < 3 then list_append(list_filter(f.held, lambda t: e.us - t < 21600000000), e.us) else list_filter(f.held, lambda t: e.us - t < 21600000000) end
            from f join e on e.user_id = f.user_id and e.i = f.i + 1)
        select event_id, user_id, accepted from f""",
    "sliding_request_rate": "select event_id, count(*) over (partition by user_id order by ts range between interval 1 hour preceding and current row) as rate from events",
    "sessions": """
        with g as (select user_id, ts, coalesce(ts - lag(ts) over w > interval 30 minutes, true)::int as n from events where user_id is not null and ts is not null window w as (partition by user_id order by ts)),
        s as (select user_id, ts, sum(n) over (partition by user_id order by ts)::bigint as session from g)
        select user_id, session, min(ts) as started, max(ts) as ended, count(*) as requests from s group by user_id, session""",
    "heartbeat_5m": "select epoch(time_bucket(interval 5 minutes, ts))::bigint as start, count(*) as requests, count(*) filter (event_type = 'error') as errors from events group by 1",
    "cumulative_totals": "select start, sum(n) over (order by start)::bigint as all_requests, sum(e) over (order by start)::bigint as all_errors from (select epoch(date_trunc('day', ts))::bigint as start, count(*) as n, count(*) filter (event_type = 'error') as e from events group by 1)",
    "last_sources": "select user_id, props as value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as k from events where event_type = 'view' and props is not null and user_id is not null) where k = 1",
    "history_trim": "select event_id, user_id, k::int as k from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as k from events) where k <= 40",
    "classifier_context": """
        with m as (select user_id, row_number() over (partition by user_id order by ts desc, event_id desc) as k, case when event_type = 'view' then 'User: ' else 'Assistant: ' end || case when length(props) > 8 then substr(props, 1, 8) || '…' else props end as m from events)
        select user_id, string_agg(m, chr(10) order by k desc) as context from m where k <= 4 group by user_id""",
    "stage_timings": """
        with s as (select user_id, event_type as t, round(sum(value), 2) as v from events where event_type in ('signup', 'view', 'click', 'purchase') group by 1, 2)
        select u.user_id, coalesce(string_agg(t || '=' || printf('%.2f', v), ' ' order by list_position(['signup', 'view', 'click', 'purchase'], t)), '') as line from (select distinct user_id from events) u left join s using (user_id) group by u.user_id""",
    "personal_data": "select case " + " ".join(f"when regexp_matches(text, '{p}') then '{n}'" for n, p, _ in sorted(R.PERSONAL, key=lambda x: -x[2])) + " end as kind, count(*) as n from documents group by 1",
    "link_intent": "with q(k, question, wants, asks) as (values " + ", ".join(f"({i}, '{q.replace(chr(39), chr(39) * 2)}', {w}, {a})" for i, (q, w, a) in enumerate(QUESTIONS)) + f") select question, wants, asks, count(*) as n from documents join q on k = doc_id % {len(QUESTIONS)} group by all",
    "link_mentions": f"select doc_id, list_has_any(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+'), {R.MENTIONS}) as wants from documents",
    "strip_source_markers": "select distinct chunk_id, trim(regexp_replace(coalesce(title, 'x') || ' and more [text](url)', '[ \\t]{2,}', ' ', 'g')) as text from chunks",
}
