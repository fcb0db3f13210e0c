"""Queries of the request side, with SQL. Models are stand-ins that answer by simple rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import assistant as A
from tidemark.operators import requests as R
from tidemark.sources.tables import table

CANNED = {"off_topic": "I can only help with elections.", "abuse": "Please keep it civil.", "unclassified": "Please try again."}
PASSING = ["question", "smalltalk", "concern"]
PRICES = [("small-model", 0.5, 1), ("small", 0.25, 2), ("large", 4.0, 3), ("large-2", 8.0, 4)]
MODELS = ["small-model", "small-model-2025", "smaller", "large-2", "large-20", "other"]
SPECS = [(1, "docs", "(?i)ballot"), (1, "nothing", "x"), (2, None, "(?i)recount|audit"), (3, "press", None)]


def _kinds(texts: list[str | None]) -> list[str | None]:
    return [None if t is None else "question" if "ballot" in t.lower() else "abuse" if "idiot" in t.lower() else "off_topic" if len(t) % 3 == 0 else "riddle" if len(t) % 3 == 1 else "smalltalk" for t in texts]


def _asks(spark: SparkSession, d: str) -> DataFrame:
    user = F.when(F.col("doc_id") % 17 == 0, "bad user!").otherwise(F.concat(F.lit("u-"), F.col("doc_id").cast("string")))
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), user.alias("user_id"), F.coalesce("title", F.lit("")).alias("query"))


def request_validation(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 17 == 0, "bad user!").otherwise("u_1").alias("user_id"), F.col("text").alias("query"))
    return rows.groupBy(A.invalid(F.col("user_id"), F.col("query")).alias("invalid")).agg(F.count("*").alias("n"))


def canned_answers(spark: SparkSession, d: str) -> DataFrame:
    rows = A.gated(_asks(spark, d), _kinds, CANNED, PASSING, tag="Questions about")
    return rows.groupBy("category", "canned").agg(F.count("*").alias("n"))


def outcome_buckets(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_type")
    rows = table(spark, d, "events").select(A.outcome(F.when(e == "view", "question").when(e == "click", "off_topic").when(e == "signup", "abuse"), F.when(e == "error", "timeout"), PASSING).alias("outcome"))
    return rows.groupBy("outcome").agg(F.count("*").alias("n"))


def chat_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """The whole pipeline: refused, canned, and generated answers, of which those that the check marks every time are safe ones."""
    context = lambda rows: rows.filter("id % 2 = 0").select("id", F.lit("Context [Source 1]").alias("context"))
    made = A.chat(
        _asks(spark, d), _kinds, context, lambda texts: [None if "county" in t.lower() else f"{t} [Source 1]" for t in texts], lambda answers: ["yes" if "Recount" in a else "no" for a in answers], CANNED, PASSING, "No answer."
    )
    return made.select("id", "outcome", "answer")


def model_costs(spark: SparkSession, d: str) -> DataFrame:
    """Tokens and cost per model: documents' lengths as tokens, models by id."""
    model = F.element_at(F.array(*map(F.lit, MODELS)), (F.col("doc_id") % len(MODELS) + 1).cast("int"))
    calls = table(spark, d, "documents").select(model.alias("model"), F.coalesce(F.length("text"), F.lit(0)).alias("tokens"))
    priced = A.priced(calls, spark.createDataFrame(PRICES, "name string, price double, ord int"))
    return priced.groupBy("model").agg(F.sum("tokens").alias("tokens"), F.round(F.sum(F.col("tokens") * F.col("price")) / 1_000_000, 6).alias("cost"))


def two_rate_limits(spark: SparkSession, d: str) -> DataFrame:
    return A.two_limits(table(spark, d, "events"), "user_id", "ts", "event_id", 2, 20, 6 * 3600).groupBy("user_id", "verdict").agg(F.count("*").alias("n"))


def failure_log(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").filter("event_type = 'error'")
    return A.throttled(rows, "user_id", "ts", "event_id", 24 * 3600).select("event_id", "user_id", "suppressed")


def expired_sessions(spark: SparkSession, d: str) -> DataFrame:
    """When the sweep, once a day, finds each session over."""
    rows = R.sessions(table(spark, d, "events"), "user_id", "ts", 6 * 3600).select("user_id", "session", "ended")
    ticks = table(spark, d, "events").agg(F.min(F.date_trunc("day", "ts")).alias("a"), F.max(F.date_trunc("day", "ts")).alias("b")).select(F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("t"))
    ticks = ticks.select(F.col("t").cast("timestamp_ntz").alias("at"))
    return A.swept_sessions(rows, ticks, 6 * 3600).select("user_id", "session", "gone_at")


def callback_states(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").withColumn("call", F.floor(F.col("event_id") / 3))
    return A.pruned_callbacks(rows, "call", "ts", F.col("event_id") % 3 == 0, (F.col("event_id") % 3 == 2) & (F.col("event_type") != "error"), 600).groupBy("state").agg(F.count("*").alias("n"))


def context_600(spark: SparkSession, d: str) -> DataFrame:
    """The last four texts of each source as a classifier sees them."""
    rows = table(spark, d, "documents").filter("text is not null")
    return A.classifier_input(rows, "source", ["retrieved_at", "doc_id"], F.when(F.col("doc_id") % 2 == 0, "User").otherwise("Assistant"), F.col("text")).select("source", F.md5("context").alias("digest"), F.length("context").alias("n"))


def retrieved_documents(spark: SparkSession, d: str) -> DataFrame:
    doc = A.retrieved(F.col("title"), F.col("text"), F.col("chunk_index") / 7, F.col("source_url"), F.array_union(F.coalesce("source_urls", F.array().cast("array<string>")), F.array(F.lit("unknown"))))
    rows = table(spark, d, "chunks").select("chunk_id", doc.alias("d")).distinct()
    return rows.select("chunk_id", "d.title", F.length("d.text").alias("n"), "d.score", "d.url", F.array_join("d.urls", " ").alias("urls"))


def source_numbers(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "links").select("id", "source_url", "target_url").dropna()
    return A.numbered_sources(rows, "source_url", [F.col("id")]).select("id", "source_number")


def cached_links(spark: SparkSession, d: str) -> DataFrame:
    """Each document's pretended sources as a list of links."""
    s = F.struct(F.col("title").alias("title"), F.col("url").alias("url"))
    other = F.struct(F.lit("Help").alias("title"), F.when(F.col("doc_id") % 3 == 0, "https://h.example/").alias("url"))
    return table(spark, d, "documents").select("doc_id", A.link_list(F.array(s, other, s), "No sources yet.").alias("links"))


def escaped_messages(spark: SparkSession, d: str) -> DataFrame:
    t = F.concat(F.lit("#survey {a_b} 50% "), F.coalesce("title", F.lit("")))
    return table(spark, d, "documents").select("doc_id", A.without_tag(t, "#survey").alias("plain"), A.template_safe(t).alias("template"), A.like_safe(t).alias("pattern"))


def request_log(spark: SparkSession, d: str) -> DataFrame:
    rows = _asks(spark, d)
    return rows.select("id", A.log_line(F.col("user_id"), F.lit("ok"), F.col("query")).alias("line"))


def gold_match(spark: SparkSession, d: str) -> DataFrame:
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "url", "text")
    return A.gold_matches(texts, spark.createDataFrame(SPECS, "item int, url string, pattern string"))


def evaluation_drift(spark: SparkSession, d: str) -> DataFrame:
    """Reviewers' judgements against the language of the document's id, per category: what differs from the expected, and from each other."""
    rows = table(spark, d, "review_labels").withColumn("expected", (F.col("doc_id") % 5 == 0).cast("int")).withColumn("second", F.when(F.col("doc_id") % 7 == 0, 1).otherwise(F.col("abusive")))
    return A.drift(rows, ["category"], "expected", ["abusive", "second"])


def response_statuses(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("event_type") == "error", 500).when(F.col("value") > 18, 429).otherwise(200)
    return table(spark, d, "events").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def history_messages(spark: SparkSession, d: str) -> DataFrame:
    """Events as chat messages: those of users and the assistant only."""
    role = F.when(F.col("event_type") == "view", "user").when(F.col("event_type") == "click", "assistant").when(F.col("event_type") == "error", "system")
    rows = table(spark, d, "events").select("event_id", role.alias("role"), F.col("props").alias("content"))
    return rows.filter(F.col("role").isin("user", "assistant"))


def numbered_context(spark: SparkSession, d: str) -> DataFrame:
    block = R.context_block(F.col("title"), F.array_compact(F.array("source_url")), F.col("text"), F.col("chunk_index") + 1)
    return table(spark, d, "chunks").filter("text is not null").select("chunk_id", F.md5(block).alias("digest")).distinct()


def linked_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers with markers, linked to two sources each; unknown numbers vanish."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("title", F.lit("t")).alias("title"), "url").filter("url is not null")
    answers = docs.select(F.col("doc_id").alias("answer_id"), F.lit("One [Source 1], two [Source 2, 1]; none [Source 9] or [Sources: all] but [a](b).").alias("text"))
    one = docs.select(F.col("doc_id").alias("answer_id"), F.lit(1).alias("number"), F.replace("title", F.lit("["), F.lit("(")).alias("title"), "url")
    two = docs.select(F.col("doc_id").alias("answer_id"), F.lit(2).alias("number"), F.lit("Two").alias("title"), F.lit("u2").alias("url"))
    return R.linked(answers, one.unionByName(two))


QUERIES = {
    f.__name__: f
    for f in (
        request_validation, canned_answers, outcome_buckets, chat_outcomes, model_costs, two_rate_limits, failure_log, expired_sessions, callback_states, context_600, retrieved_documents, source_numbers, cached_links,
        escaped_messages, request_log, gold_match, evaluation_drift, response_statuses, history_messages, numbered_context, linked_answers,
    )
}

_CASE = "case when contains(lower({0}), 'ballot') then 'question' when contains(lower({0}), 'idiot') then 'abuse' when length({0}) % 3 = 0 then 'off_topic' when length({0}) % 3 = 1 then 'riddle' else 'smalltalk' end"
_SAID = "case c when 'off_topic' then 'I can only help with elections.' when 'abuse' then 'Please keep it civil.' when 'unclassified' then 'Please try again.' end"
_Q = "select doc_id as id, doc_id % 17 <> 0 as good, coalesce(title, '') as q from documents"


def _folded(limit: int, held: str) -> str:
    return f"len(list_filter({held}, lambda t: e.us - t < 21600000000)) < {limit}"


SQL = {
    "request_validation": "select case when doc_id % 17 = 0 then 'user_id' when not coalesce(length(text) between 1 and 2000, false) then 'query' end as invalid, count(*) as n from documents group by 1",
    "canned_answers": f"with q as ({_Q}), k as (select case when starts_with(q, 'Questions about') then 'question' else {_CASE.format('q')} end as k from q), c as (select case when k = 'riddle' then 'unclassified' else k end as c from k) select c as category, {_SAID} as canned, count(*) as n from c group by 1, 2",
    "outcome_buckets": "select case event_type when 'error' then 'error:timeout' when 'view' then 'ok' when 'click' then 'blocked:off_topic' when 'signup' then 'blocked:abuse' else 'blocked:unclassified' end as outcome, count(*) as n from events group by 1",
    "chat_outcomes": f"""with q as ({_Q}), k as (select *, {_CASE.format('q')} as k from q), c as (select *, case when k = 'riddle' then 'unclassified' else k end as c from k),
        r as (select *, case when not good then 'error:user_id' when q = '' then 'error:query' when c in ('question', 'smalltalk') then 'ok' else 'blocked:' || c end as outcome, case when id % 2 = 0 then 'Context' || chr(10) || q else chr(10) || q end as p from c)
        select id, outcome, case when outcome like 'error%' then null when outcome like 'blocked%' then {_SAID} when contains(lower(p), 'county') then 'No answer.' when contains(p, 'Recount') then 'No answer.'
               else regexp_replace(case when id % 2 = 0 then replace(p, 'Context', 'Context') else p end, '[ \\t]{{2,}}', ' ', 'g') end as answer from r""",
    "model_costs": f"""with p(name, price, ord) as (values {', '.join(map(str, PRICES))}), c as (select {MODELS}[doc_id % {len(MODELS)} + 1] as model, coalesce(length(text), 0) as tokens from documents),
        b as (select model, price, row_number() over (partition by model order by name <> model, ord) as k from (select distinct model from c) m join p on starts_with(model, name))
        select c.model, sum(tokens)::bigint as tokens, round(sum(tokens * coalesce(price, 0)) / 1000000, 6) as cost from c left join b on b.model = c.model and k = 1 group by 1""",
    "two_rate_limits": f"""
        with recursive e as (select event_id, user_id, epoch_us(ts) as us, row_number() over (partition by user_id order by ts, event_id) as i from events where user_id is not null and ts is not null),
        f as (select event_id, user_id, us, i, true as ok, [us] as held from e where i = 1
            union all select e.event_id, e.user_id, e.us, e.i, {_folded(2, 'f.held')}, case when {_folded(2, 'f.held')} then list_append(list_filter(f.held, lambda t: e.us - t < 21600000000), e.us) else list_filter(f.held, lambda t: e.us - t < 21600000000) end
            from f join e on e.user_id = f.user_id and e.i = f.i + 1),
        a as (select event_id, us, row_number() over (order by us, event_id) as i from f where ok),
        g as (select event_id, i, true as ok, [us] as held from a where i = 1
            union all select e.event_id, e.i, {_folded(20, 'g.held')}, case when {_folded(20, 'g.held')} then list_append(list_filter(g.held, lambda t: e.us - t < 21600000000), e.us) else list_filter(g.held, lambda t: e.us - t < 21600000000) end
            from g join a e on e.i = g.i + 1)
        select user_id, case when not f.ok then 'user' when not g.ok then 'global' else 'accepted' end as verdict, count(*) as n from f left join g using (event_id) group by 1, 2""",
    "failure_log": """
        with recursive e as (select event_id, user_id, ts, row_number() over (partition by user_id order by ts, event_id) as i from events where event_type = 'error' and user_id is not null and ts is not null),
        f as (select event_id, user_id, ts as last, i, true as told from e where i = 1
            union all select e.event_id, e.user_id, case when epoch_us(e.ts) - epoch_us(f.last) >= 86400000000 then e.ts else f.last end, e.i, epoch_us(e.ts) - epoch_us(f.last) >= 86400000000 from f join e on e.user_id = f.user_id and e.i = f.i + 1)
        select event_id, user_id, i - coalesce(lag(i) over (partition by user_id order by i), 0) - 1 as suppressed from f where told""",
    "expired_sessions": """
        with g as (select user_id, ts, coalesce(ts - lag(ts) over w > interval 6 hours, true)::int as n from events where user_id is not null and ts is not null window w as (partition by user_id order by ts)),
        s as (select user_id, session, max(ts) as ended from (select user_id, ts, sum(n) over (partition by user_id order by ts)::bigint as session from g) group by 1, 2),
        t as (select unnest(generate_series(min(date_trunc('day', ts)), max(date_trunc('day', ts)), interval 1 day)) as tick from events)
        select user_id, session, min(tick) as gone_at from s left join t on tick > ended + interval 6 hours group by user_id, session, ended""",
    "callback_states": """with s as (select event_id // 3 as c, min(ts) filter (event_id % 3 = 0) as a, max(ts) filter (event_id % 3 = 2 and event_type <> 'error') as b from events group by 1)
        select case when b - a <= interval 10 minutes then 'closed' when (select max(ts) from events) - a > interval 10 minutes then 'pruned' else 'open' end as state, count(*) as n from s where a is not null group by 1""",
    "context_600": """with m as (select source, row_number() over (partition by source order by retrieved_at desc nulls last, doc_id desc) as k, case when doc_id % 2 = 0 then 'User: ' else 'Assistant: ' end || case when length(text) > 600 then substr(text, 1, 600) || '…' else text end as m from documents where text is not null)
        select source, md5(c) as digest, length(c)::int as n from (select source, string_agg(m, chr(10) order by k desc) as c from m where k <= 4 group by source)""",
    "retrieved_documents": """select distinct chunk_id, coalesce(title, 'unknown') as title, length(coalesce(text, ''))::int as n, round(chunk_index / 7, 4) as score, coalesce(source_url, 'unknown') as url,
        coalesce(nullif((select string_agg(u, ' ' order by i) from (select u, min(i) as i from (select unnest(source_urls) as u, unnest(range(len(source_urls))) as i) group by u) where u is not null and u not in ('unknown', '')), ''), coalesce(source_url, 'unknown')) as urls from chunks""",
    "source_numbers": "select id, row_number() over (partition by source_url order by id)::int as source_number from links where id is not null and source_url is not null and target_url is not null",
    "cached_links": "select doc_id, case when coalesce(url, '') = '' and doc_id % 3 <> 0 then 'No sources yet.' else concat_ws(chr(10), case when coalesce(url, '') <> '' then '- [' || coalesce(title, url) || '](' || url || ')' end, case when doc_id % 3 = 0 and coalesce(url, '') <> 'https://h.example/' then '- [Help](https://h.example/)' end) end as links from documents",
    "escaped_messages": """with t as (select doc_id, '#survey {a_b} 50% ' || coalesce(title, '') as t from documents) select doc_id, trim(replace(t, '#survey', '')) as plain, replace(replace(t, '{', '{{'), '}', '}}') as template,
        replace(replace(replace(t, '!', '!!'), '%', '!%'), '_', '!_') as pattern from t""",
    "request_log": "select doc_id as id, 'user=' || substr(sha256(case when doc_id % 17 = 0 then 'bad user!' else 'u-' || doc_id end), 1, 12) || ' outcome=ok text=<' || length(coalesce(title, '')) || ' chars>' as line from documents",
    "gold_match": """with s(item, u, p) as (values (1, 'docs', '(?i)ballot'), (1, 'nothing', 'x'), (2, null, '(?i)recount|audit'), (3, 'press', null))
        select distinct item, doc_id as id from documents join s on (u is null or contains(url, u)) and (p is null or regexp_matches(text, p))""",
    "evaluation_drift": """with r as (select category, abusive, (doc_id % 5 = 0)::int as x, case when doc_id % 7 = 0 then 1 else abusive end as second from review_labels)
        select category, count(*) as n, count(*) filter (abusive is distinct from x) as wrong_abusive, count(*) filter (second is distinct from x) as wrong_second, count(*) filter (abusive is distinct from second) as drift from r group by 1""",
    "response_statuses": "select case when event_type = 'error' then 500 when value > 18 then 429 else 200 end as status, count(*) as n from events group by 1",
    "history_messages": "select event_id, case event_type when 'view' then 'user' else 'assistant' end as role, props as content from events where event_type in ('view', 'click')",
    "numbered_context": "select distinct chunk_id, md5('[Source ' || (chunk_index + 1) || ']: ' || coalesce(title, 'unknown') || chr(10) || 'URL: ' || coalesce(source_url, '') || chr(10) || text) as digest from chunks where text is not null",
    "linked_answers": "select doc_id as answer_id, 'One [' || t || '](' || url || '), two [Two](u2) [' || t || '](' || url || '); none or but [a](b).' as text from (select *, replace(coalesce(title, 't'), '[', '(') as t from documents where url is not null)",
}
