"""Crawl policy, request stages, routing and upkeep on small tables with nulls, ties and empty inputs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import assistant, crawl, routing, upkeep

T0 = dt.datetime(2024, 1, 1)


def test_url_gate_and_status(spark):
    rules = [(r"/old/", "old"), (r"/(?!2026)\d{4}/", "year")]
    urls = ["https://h/old/a", "https://h/OLD/keep%20me", "https://h/2025/x", "https://h/2026/x", "https://h/a.DOC", "https://h/a.png", "ftp://h/a", "", None, "https://h/ok"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    got = [r[0] for r in df.select(crawl.exclusion(F.col("u"), rules, prefixes=["https://h/old/keep me"])).collect()]
    assert got == ["old", None, "year", None, "legacy document", "file type", "no web address", "empty", "empty", None]
    states = [(200,), (304,), (403,), (404,), (408,), (410,), (418,), (429,), (500,), (None,)]
    got = [r[0] for r in spark.createDataFrame(states, "s int").select(crawl.status_class(F.col("s"))).collect()]
    assert got == ["ok", "unchanged", "retry", "excluded", "retry", "excluded", "client", "retry", "retry", "retry"]


def test_crawled_rows_are_never_demoted_and_sweeps_wait_for_failures(spark):
    df = spark.createDataFrame([("crawled", "failed"), ("failed", "crawled"), ("pending", None), (None, "failed")], "a string, b string")
    assert [r[0] for r in df.select(crawl.merged_status(F.col("a"), F.col("b"))).collect()] == ["crawled", "crawled", "pending", "failed"]
    pages = spark.createDataFrame([(1, "https://h/A", "crawled"), (2, "https://h/b", "crawled"), (3, "https://h/c", "failed"), (4, "https://h/d", "crawled")], "id int, url string, crawl_status string")
    fetched = spark.createDataFrame([("https://h/a",), ("https://h/d",)], "url string")
    assert {r.id: r.verdict for r in crawl.sweep(pages, fetched, 0).collect()} == {1: "case duplicate", 2: "orphan"}
    assert {r.id: r.verdict for r in crawl.sweep(pages, fetched, 1).collect()} == {1: "case duplicate", 2: "kept"}
    assert crawl.sweep(pages.limit(0), fetched, 0).count() == 0


def test_chat_stages_and_failing_models(spark):
    rows = spark.createDataFrame([(1, "u", "hello"), (2, "u u", "hello"), (3, "u", ""), (4, "u", "bad"), (5, "u", "odd"), (6, None, "x"), (7, "u", None)], "id int, user_id string, query string")

    def classify(texts):
        return ["ask" if t == "hello" else "rude" if t == "bad" else "new" for t in texts]

    def broken(texts):
        raise RuntimeError("no model")

    none = lambda r: r.select("id", F.lit(None).cast("string").alias("context"))
    run = lambda gen, check: {r.id: (r.outcome, r.answer) for r in assistant.chat(rows, classify, none, gen, check, {"rude": "no", "unclassified": "again"}, ["ask"], "safe").collect()}
    got = run(lambda t: [f"re {x.strip()}" for x in t], lambda t: ["no"] * len(t))
    assert got == {1: ("ok", "re hello"), 2: ("error:user_id", None), 3: ("error:query", None), 4: ("blocked:rude", "no"), 5: ("blocked:unclassified", "again"), 6: ("error:user_id", None), 7: ("error:query", None)}
    assert run(lambda t: ["x"] * len(t), broken)[1] == ("ok", "safe") and run(broken, lambda t: ["no"] * len(t))[1] == ("ok", "safe")


def test_a_global_rejection_uses_up_the_users_slot(spark):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    rows = [(1, "a", at(0)), (2, "b", at(1)), (3, "a", at(2)), (4, "a", at(3)), (5, "c", at(61))]
    df = spark.createDataFrame(rows, "id int, u string, ts timestamp")
    got = {r.id: r.verdict for r in assistant.two_limits(df, "u", "ts", "id", 2, 2, 60).collect()}
    assert got == {1: "accepted", 2: "accepted", 3: "global", 4: "user", 5: "accepted"}
    quiet = {r.id: r.suppressed for r in assistant.throttled(df, "u", "ts", "id", 60).collect()}
    assert quiet == {1: 0, 2: 0, 5: 0} and assistant.two_limits(df.limit(0), "u", "ts", "id", 2, 2, 60).count() == 0


def test_links_and_texts_of_answers(spark):
    df = spark.createDataFrame([([("a", "u"), ("b", "u"), ("c", None), (None, "v")],), ([],), (None,)], "s array<struct<title:string,url:string>>")
    assert [r[0] for r in df.select(assistant.link_list(F.col("s"), "none")).collect()] == ["- [a](u)\n- [v](v)", "none", "none"]
    one = spark.createDataFrame([("50%_{x}!",)], "t string")
    assert one.select(assistant.like_safe(F.col("t")), assistant.template_safe(F.col("t"))).first()[:] == ("50!%!_{x}!!", "50%_{{x}}!")
    prices = spark.createDataFrame([("m", 1.0, 1), ("m-2", 2.0, 2), ("m-2-x", 3.0, 3)], "name string, price double, ord int")
    calls = spark.createDataFrame([("m-2",), ("m-2-x-1",), ("q",), (None,)], "model string")
    assert {r.model: r.price for r in assistant.priced(calls, prices).collect()} == {"m-2": 2.0, "m-2-x-1": 1.0, "q": 0.0, None: 0.0}


def test_routing_of_texts(spark):
    df = spark.createDataFrame([("short", None, "x" * 30), (None, " ", None), ("a b", "y" * 25, "z")], "a string, b string, c string")
    text, place = routing.cascade(F.col("a"), F.col("b"), F.col("c"))
    assert [tuple(r) for r in df.select(text, place).collect()] == [("x" * 30, 3), (None, None), ("y" * 25, 2)]
    kinds = spark.createDataFrame([("application/PDF; q=1", "html"), (None, "XLSM"), ("x/y", "zip"), (None, None)], "m string, e string")
    assert [r[0] for r in kinds.select(routing.payload_kind(F.col("m"), F.col("e"))).collect()] == ["pdf", "xlsx", None, None]
    levels = spark.createDataFrame([('["A", "B"]',), ("plain",), ("",), (None,)], "h string").select(routing.hierarchy(F.col("h")))
    assert [r[0] for r in levels.collect()] == [["A", "B"], ["plain"], [], []]


def test_reading_order_of_two_columns(spark):
    blocks = [(1, 1, 20.0, 580.0, 0.0, 10.0), (1, 2, 20.0, 280.0, 20.0, 60.0), (1, 3, 320.0, 580.0, 20.0, 60.0), (1, 4, 20.0, 280.0, 70.0, 99.0), (1, 5, 320.0, 580.0, 70.0, 99.0), (1, 6, 20.0, 580.0, 120.0, 130.0), (1, 7, 320.0, 580.0, 140.0, 150.0), (2, 1, 20.0, 280.0, 9.0, 10.0)]
    df = spark.createDataFrame([(*b, 600.0) for b in blocks], "page int, block int, x0 double, x1 double, y0 double, y1 double, width double")
    got = sorted((r.page, r.place, r.block) for r in routing.reading_order(df).collect())
    assert [b for p, _, b in got if p == 1] == [1, 2, 4, 3, 5, 6, 7] and got[-1] == (2, 1, 1)


def test_walks_plans_and_gates(spark, tmp_path):
    listing = spark.createDataFrame([(1, 0, "2026-a", True), (2, 1, "f.pdf", False), (3, 1, "../x", False), (4, 0, "other", True), (5, 4, "g", False), (6, 1, "sub", True), (7, 6, "h", False), (8, 0, "top.txt", False), (9, 1, None, False)], "id long, parent long, name string, folder boolean")
    assert {r.id: r.key for r in upkeep.walk(listing, 0, "2026-").collect()} == {2: "2026-a/f.pdf", 7: "2026-a/sub/h", 8: "top.txt"}
    keys = spark.createDataFrame([("a/b",), ("../a",), ("/a",), ("a//b",), (None,)], "k string").select(upkeep.local_path("/r", F.col("k")))
    assert [r[0] for r in keys.collect()] == ["/r/a/b", None, None, None, None]
    expected = spark.createDataFrame([(f"u{i}",) for i in range(10)], "url string")
    chunks = lambda n: spark.createDataFrame([(f"u{i}", [f"u{i + 1}"]) for i in range(n)], "source_url string, source_urls array<string>")
    assert [r.url for r in upkeep.coverage_gate(expected, chunks(8)).collect()] == ["u9"]
    with pytest.raises(upkeep.Uncovered):
        upkeep.coverage_gate(expected, chunks(6))
    store = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])], "id long, embedding array<float>")
    new = spark.createDataFrame([(2, [9.0, 9.0]), (3, [1.0]), (None, [1.0, 1.0]), (4, None), (5, [float("nan"), 1.0])], "id long, embedding array<float>")
    kept, counts = upkeep.store_vectors(store, new, 2)
    assert {r.id: list(r.embedding) for r in kept.collect()} == {1: [1.0, 2.0], 2: [9.0, 9.0]} and counts.first()[:] == (1, 4)
    lines = spark.createDataFrame([("f", 1, '{"k": 1}'), ("f", 2, " "), ("f", 3, "{k"), ("f", 4, None)], "file string, line_no long, value string")
    assert {r.line_no: r.fault for r in upkeep.numbered_lines(lines, "k int").collect()} == {1: None, 3: "f:3"}
    path = upkeep.versioned_copy(store, f"file://{tmp_path}", "v1")
    assert upkeep.versioned_copy(store.limit(0), f"file://{tmp_path}", "v1") == path and spark.read.parquet(path).count() == 2
