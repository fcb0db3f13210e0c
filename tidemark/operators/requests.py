"""Requests over time: sliding-window limits, sessions, rates, heartbeats, histories, and the texts of answers."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Requests in WINDOW seconds that a user may make, and seconds of silence after which a session is over.
LIMIT, WINDOW, SILENCE = 20, 60, 30 * 60
#: Kinds of personal data with the patterns that find them and how sure a hit is (fixed values).
PERSONAL = [
    ("EMAIL", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", 1.0), ("SSN", r"\b\d{3}-\d{2}-\d{4}\b", 0.85), ("CARD", r"\b(?:\d[ -]?){12,15}\d\b", 0.8),
    ("PHONE", r"(?:\(\d{3}\) ?|\b\d{3}[-.])\d{3}[-.]\d{4}\b", 0.75), ("IP", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", 0.6),
]


class Limiter:
    """Accepted times per key within a sliding window; a rejected request leaves no trace."""

    def __init__(self, limit: int, seconds: float) -> None:
        self.limit, self.seconds = limit, seconds
        self.accepted: deque[float] = deque()

    def check(self, at: float) -> bool:
        while self.accepted and at - self.accepted[0] >= self.seconds:
            self.accepted.popleft()
        if len(self.accepted) >= self.limit:
            return False
        self.accepted.append(at)
        return True


def limit_decisions(rows: DataFrame, key: str, at: str, order: str, limit: int = LIMIT, seconds: float = WINDOW) -> DataFrame:
    """(order, key, accepted) per request, in order of time and then `order`. Requests without a key or time are left out.

    Rows are sorted by key and time within partitions and streamed: the state is at most `limit` times of the present key, however
    many requests a key has.
    """
    times = rows.filter(F.col(key).isNotNull() & F.col(at).isNotNull()).select(key, F.unix_micros(F.col(at).cast("timestamp")).alias("_us"), order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        present, limiter = object(), Limiter(limit, seconds * 1_000_000)
        for batch in batches:
            out = []
            for k, us in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if k != present:
                    present, limiter = k, Limiter(limit, seconds * 1_000_000)
                out.append(limiter.check(us))
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(0), pa.array(out, pa.bool_())], [order, key, "accepted"])

    kinds = {f.name: f.dataType.simpleString() for f in times.schema.fields}
    return times.repartition(key).sortWithinPartitions(key, "_us", order).mapInArrow(run, f"`{order}` {kinds[order]}, `{key}` {kinds[key]}, accepted boolean")


#: Length of the stretches of time into which a key's requests are cut, so that a key with very many is spread over tasks.
STRETCH = 24 * 3600


def sliding_rate(rows: DataFrame, key: str, at: str, seconds: int = WINDOW) -> DataFrame:
    """rows with `rate`, the requests of the key within the seconds up to and including each. Rows of a null key count together.

    Each stretch of a key's time is a partition of its own, which also has the requests of the last seconds of the stretch before.
    """
    span, back = max(STRETCH, seconds) * 1_000_000, seconds * 1_000_000
    timed = rows.withColumn("_us", F.unix_micros(F.col(at).cast("timestamp")))
    mine, last = F.floor(F.col("_us") / span), F.floor((F.col("_us") + back) / span)
    cut = timed.withColumn("_mine", mine).withColumn("_part", F.explode(F.when(F.col("_us").isNull(), F.array(F.lit(None).cast("bigint"))).otherwise(F.sequence("_mine", last))))
    frame = Window.partitionBy(key, "_part").orderBy("_us").rangeBetween(-back, 0)
    counted = cut.withColumn("rate", F.count("*").over(frame))
    return counted.filter(F.col("_part").eqNullSafe(F.col("_mine"))).drop("_us", "_mine", "_part")


def sessions(rows: DataFrame, key: str, at: str, silence: int = SILENCE) -> DataFrame:
    """(key, session, started, ended, requests): a session is over after more than `silence` seconds without a request.

    Gaps are found within stretches of a key's time; where a stretch goes on from the one before follows from a table with one row per
    key and stretch. Rows without a key or time are left out.
    """
    there = rows.filter(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.col(key).alias("_key"), F.col(at).alias("_at"), F.unix_micros(F.col(at).cast("timestamp")).alias("_us"))
    there = there.withColumn("_part", F.floor(F.col("_us") / (STRETCH * 1_000_000)))
    in_order = Window.partitionBy("_key").orderBy("_part")
    ends = there.groupBy("_key", "_part").agg(F.max("_us").alias("_last")).withColumn("_before", F.lag("_last").over(in_order)).drop("_last")
    within = Window.partitionBy("_key", "_part").orderBy("_us")
    gap = F.col("_us") - F.coalesce(F.lag("_us").over(within), F.col("_before"))
    marked = there.join(ends, ["_key", "_part"]).withColumn("_new", F.coalesce(gap > silence * 1_000_000, F.lit(True)).cast("int"))
    starts = marked.groupBy("_key", "_part").agg(F.sum("_new").alias("_n"))
    base = starts.withColumn("_base", F.coalesce(F.sum("_n").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    counted = marked.withColumn("_k", F.sum("_new").over(within.rangeBetween(Window.unboundedPreceding, 0))).join(base, ["_key", "_part"])
    return counted.groupBy(F.col("_key").alias(key), (F.col("_base") + F.col("_k")).alias("session")).agg(F.min("_at").alias("started"), F.max("_at").alias("ended"), F.count("*").alias("requests"))


def heartbeat(rows: DataFrame, at: str, kind: str, every: str = "5 minutes") -> DataFrame:
    """(start, requests, errors, and totals so far) per interval with requests. The running totals go over the intervals, not the requests."""
    grouped = rows.groupBy(F.window(F.col(at).cast("timestamp"), every).alias("w")).agg(F.count("*").alias("requests"), F.count_if(F.col(kind) == "error").alias("errors"))
    so_far = Window.orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    beats = grouped.select(F.col("w.start").alias("start"), "requests", "errors")
    return beats.withColumn("all_requests", F.sum("requests").over(so_far)).withColumn("all_errors", F.sum("errors").over(so_far))


def last_known(rows: DataFrame, key: str, at: str, value: Column, order: str) -> DataFrame:
    """(key, value): the last value that isn't null of each key."""
    return rows.withColumn("_v", value).filter(F.col("_v").isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max_by("_v", F.struct(at, order)).alias("value"))


def personal_data(text: Column) -> Column:
    """The kind of personal data of the surest hit, null without one."""
    out = None
    for name, pattern, _ in sorted(PERSONAL, key=lambda p: -p[2]):
        hit = text.rlike(pattern)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


#: Words that name what a question about sources asks for, ask for it, hand it over, or negate (fixed values).
MENTIONS = "link links url urls source sources cite cited citation citations reference references hyperlink hyperlinks".split()
NAMED = "link links source sources url urls citation citations reference references".split()
PLAIN = "link links source sources url urls".split()
ASKING = "can could will would".split()
HANDING = "give send share show provide resend".split()
NEGATING = "no not never dont don't wont won't wouldnt wouldn't without".split()


def _words(text: Column) -> Column:
    """Lower-cased words, and each sign other than a comma as a word of its own."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-z0-9_]+(?:'[a-z]+)?|[^\sa-z0-9_,]"), F.lit(0))


def wants_links(text: Column) -> Column:
    """Whether a question speaks of links, sources or citations; false for null."""
    return F.arrays_overlap(_words(text), F.array(*map(F.lit, MENTIONS)))


def asks_for_links(text: Column) -> Column:
    """Whether a question asks outright for links; false for null.

    One pass over the words with a small state. `can you` opens a request, a verb of handing over arms it, and a named thing
    completes it; a negation on the way closes it again. `what is the url` and `sources please` are requests by themselves, the
    latter unless `no` or `not` stands before it.
    """
    def step(s: Column, w: Column) -> Column:
        asked = (w == "you") & s["last"].isin(ASKING)
        stage = (
            F.when(w.isin(NEGATING), 0).when(asked, F.greatest(s["stage"], F.lit(1))).when((s["stage"] == 1) & w.isin(HANDING), 2).otherwise(s["stage"])
        )
        what = (s["last"] == "the") & ((s["third"] == "what") & s["second"].isin("is", "are") | (s["second"] == "what's")) & w.isin(PLAIN)
        please = (w == "please") & s["last"].isin(PLAIN) & ~s["second"].isin("no", "not")
        hit = s["hit"] | (s["stage"] == 2) & w.isin(NAMED) | what | please
        return F.struct(s["second"].alias("third"), s["last"].alias("second"), w.alias("last"), stage.alias("stage"), hit.alias("hit"))

    start = F.struct(F.lit("").alias("third"), F.lit("").alias("second"), F.lit("").alias("last"), F.lit(0).alias("stage"), F.lit(False).alias("hit"))
    return F.aggregate(_words(text), start, step, lambda s: s["hit"])


def _inner(piece: Column) -> Column:
    """What stands before the closing bracket in a piece of text that followed an opening one."""
    return F.when(F.contains(piece, F.lit("]")), F.substring_index(piece, "]", 1))


def _is_tag(piece: Column) -> Column:
    """Whether a piece of text that followed an opening bracket starts with a source tag; a link's text is none, but a numbered marker always is one."""
    inner = _inner(piece)
    named = F.regexp_extract(F.lower(F.trim(inner)), r"^\w*", 0).isin("source", "sources", *[f"source{d}" for d in range(10)])
    link = F.substring(piece, F.length(inner) + 2, F.lit(1)) == "("
    return F.coalesce(named & (~link | (F.size(_numbers(piece)) > 0)), F.lit(False))


def _numbers(piece: Column) -> Column:
    """The numbers of a marker; an empty array for anything else."""
    items = F.split(F.lower(F.trim(_inner(piece))), r"\s*,\s*")
    bare = F.transform(items, lambda x: F.trim(F.regexp_replace(x, "^sources?", "")))
    first = F.startswith(F.lower(F.trim(_inner(piece))), F.lit("source"))
    return F.when(first & F.forall(bare, lambda x: x.rlike("^[0-9]{1,9}$")), F.array_distinct(bare)).otherwise(F.array().cast("array<string>"))


def _rest(piece: Column) -> Column:
    return F.substring(piece, F.length(_inner(piece)) + 2, F.length(piece))


def _unspaced(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+$", "")


def without_markers(text: Column) -> Column:
    """An answer without its source markers and other bracketed source tags, spaces tidied; links stay; null for null."""
    pieces = F.split(text, r"\[", -1)
    bare = F.aggregate(
        F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), F.element_at(pieces, 1),
        lambda done, piece: F.when(_is_tag(piece), F.concat(_unspaced(done), _rest(piece))).otherwise(F.concat(done, F.lit("["), piece)),
    )
    return F.trim(F.regexp_replace(bare, r"[ \t]{2,}", " "))


def context_block(title: Column, urls: Column, text: Column, number: Column) -> Column:
    """One numbered source as it goes into a prompt."""
    return F.concat(F.lit("[Source "), number.cast("string"), F.lit("]: "), F.coalesce(title, F.lit("unknown")), F.lit("\nURL: "), F.array_join(urls, " ; "), F.lit("\n"), text)


def linked(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """(answer_id, text): markers as links to the sources (answer_id, number, title, url); unknown numbers and other source tags vanish, repeats of a link in one marker are given once.

    An answer is cut at its opening brackets; the numbers of the pieces that start with a marker meet the sources in a join, and the
    pieces are put together again by position. Null texts stay null.
    """
    pieces = answers.select("answer_id", F.posexplode_outer(F.split("text", r"\[", -1)).alias("pos", "piece"))
    pieces = pieces.withColumn("tag", (F.col("pos") > 0) & _is_tag(F.col("piece")))
    marks = pieces.filter("tag").select("answer_id", "pos", F.posexplode(_numbers(F.col("piece"))).alias("k", "n"))
    found = marks.withColumn("number", F.col("n").cast("int")).join(sources, ["answer_id", "number"], "inner")
    link = F.concat(F.lit("["), "title", F.lit("]("), "url", F.lit(")"))
    links = found.groupBy("answer_id", "pos").agg(F.array_sort(F.collect_list(F.struct("k", link.alias("l")))).alias("l"))
    links = links.select("answer_id", "pos", F.array_join(F.array_distinct(F.transform("l", lambda x: x["l"])), " ").alias("l"))
    rows = pieces.join(links, ["answer_id", "pos"], "left")
    text = F.when(F.col("tag"), F.concat(F.when(F.col("l").isNotNull(), F.concat(F.lit(" "), "l")).otherwise(""), _rest(F.col("piece")))).when(F.col("pos") > 0, F.concat(F.lit("["), "piece")).otherwise(F.col("piece"))
    whole = rows.groupBy("answer_id").agg(F.array_sort(F.collect_list(F.struct("pos", "tag", text.alias("t")))).alias("p"))
    joined = F.aggregate("p", F.lit(""), lambda done, x: F.when(x["tag"], F.concat(_unspaced(done), x["t"])).otherwise(F.concat(done, x["t"])))
    return whole.select("answer_id", joined.alias("text"))
