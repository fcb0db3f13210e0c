import datetime as dt

from pyspark.sql import functions as F

from tidemark.operators import requests as R
from tidemark.operators import vectors as V
from tidemark.streaming import state

T0 = dt.datetime(2024, 1, 1)


def at(s):
    return T0 + dt.timedelta(seconds=s)


def test_limiter_leaves_no_trace_of_rejections(spark):
    times = [0] * 20 + [10, 59.999, 60, 60.5]
    df = spark.createDataFrame([(i, 1, at(s)) for i, s in enumerate(times)] + [(99, None, at(1)), (98, 2, None), (97, 2, at(5))], "event_id long, user_id long, ts timestamp")
    got = {r.event_id: r.accepted for r in R.limit_decisions(df, "user_id", "ts", "event_id").collect()}
    assert all(got[i] for i in range(20)) and not got[20] and not got[21] and got[22] and got[23] and got[97] and len(got) == 25


def test_sessions_end_after_more_than_the_silence(spark):
    df = spark.createDataFrame([(1, at(0)), (1, at(1800)), (1, at(3601)), (2, at(0))], "u long, ts timestamp")
    assert sorted((r.u, r.session, r.requests) for r in R.sessions(df, "u", "ts").collect()) == [(1, 1, 2), (1, 2, 1), (2, 1, 1)]
    assert R.sessions(df.limit(0), "u", "ts").count() == 0
    rates = R.sliding_rate(df.withColumn("id", F.monotonically_increasing_id()), "u", "ts", 1800)
    assert sorted((r.u, r.ts, r.rate) for r in rates.collect()) == [(1, at(0), 1), (1, at(1800), 2), (1, at(3601), 1), (2, at(0), 1)]


def test_answers(spark):
    df = spark.createDataFrame([("See this [Source 1].",), ("Both [Source 2, Source 1, 3] and [source: Manual] a [x](u).",), (None,)], "t string")
    assert [r[0] for r in df.select(R.without_markers(F.col("t"))).collect()] == ["See this.", "Both and a [x](u).", None]
    asks = ["can you send me the links?", "What's the URL?", "sources please", "no sources please", "can you not send links", "what did you mean by that reference?", None]
    one = spark.createDataFrame([(a,) for a in asks], "t string")
    assert [r[0] for r in one.select(R.asks_for_links(F.col("t"))).collect()] == [True, True, True, False, False, False, False]
    assert [r[0] for r in one.select(R.wants_links(F.col("t"))).collect()] == [True, True, True, True, True, True, False]
    answers = spark.createDataFrame([(1, "A [Source 1, 2]. B [Source 9]. C [Source 1]"), (2, "plain")], "answer_id int, text string")
    sources = spark.createDataFrame([(1, 1, "One", "u1"), (1, 2, "Two", "u2")], "answer_id int, number int, title string, url string")
    assert {r.answer_id: r.text for r in R.linked(answers, sources).collect()} == {1: "A [One](u1) [Two](u2). B. C [One](u1)", 2: "plain"}
    kinds = spark.createDataFrame([("mail a@b.org",), ("call 410-555-0100",), ("nothing",), (None,)], "t string").select(R.personal_data(F.col("t")))
    assert [r[0] for r in kinds.collect()] == ["EMAIL", "PHONE", None, None]


def test_nearest(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [2.0, 0.0]), (4, [0.0, 0.0]), (5, None)], "id long, embedding array<float>")
    got = [(r.id, r.rank, round(r.score, 3)) for r in V.top_k(rows, rows.filter("id = 1"), k=3).orderBy("rank").collect()]
    assert got == [(1, 1, 1.0), (3, 2, 1.0), (2, 3, 0.0)]
    assert V.top_k(rows, rows.filter("id = 99")).count() == 0 and V.top_k(rows, rows.filter("id = 1"), k=3, floor=0.5).count() == 2


def drain(spark, stream, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_streams_agree_with_batch(spark, tmp_path):
    rows = [(i, i % 3, at(i * 7), "error" if i % 4 == 0 else "view") for i in range(200)] + [(1000, 1, at(90_000), "view")]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, event_type string")
    df.coalesce(1).orderBy("ts").write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    beats = {(r.start, r.requests, r.errors) for r in drain(spark, state.heartbeat_stream(source()), "beats").collect()}
    batch = {(r.start, r.requests, r.errors) for r in R.heartbeat(df, "ts", "event_type").collect()}
    assert beats and beats <= batch and len(batch - beats) <= 1
    seen = {(r.user_id, r.started, r.requests) for r in drain(spark, state.session_stream(source()), "sess").collect()}
    assert seen <= {(r.user_id, r.started, r.requests) for r in R.sessions(df, "user_id", "ts").collect()} and len(seen) == 3
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    got = {(r.event_id, r.accepted) for r in drain(spark, state.limit_stream(source(), limit=2, seconds=60), "lim").collect()}
    assert got == {(r.event_id, r.accepted) for r in R.limit_decisions(df, "user_id", "ts", "event_id", 2, 60).collect()}
