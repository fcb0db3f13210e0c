from pyspark.sql import functions as F

from tidemark.operators import corpus as K
from tidemark.operators import corpus_queries
from tidemark.operators.components import components
from tidemark.operators.embedding import Refused, embed_batch, embed_table


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_first_last_upsert(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, t int")
    new = spark.createDataFrame([(2, "x", 2), (2, "y", 3), (3, "z", 1), (None, "q", 9)], "k int, v string, t int")
    once = K.upsert(old, new, "k", ["t"])
    assert rows(once) == [(1, "a", 1), (2, "y", 3), (3, "z", 1)] and rows(K.upsert(once, new, "k", ["t"])) == rows(once)
    assert rows(K.insert_or_ignore(old, new, ["k"], ["t"])) == [(1, "a", 1), (2, "b", 1), (3, "z", 1)]
    update = spark.createDataFrame([(1, None), (2, "n")], "k int, v string")
    assert rows(K.coalesce_update(old, update, "k", ["v"])) == [(1, "a", 1), (2, "n", 1)]
    assert K.first_of(new.limit(0), ["k"], ["t"]).count() == 0


def test_merge_and_coverage(spark):
    chunks = spark.createDataFrame([("c1", ["u1"]), ("c2", ["u1", "u2"]), ("c3", ["u3"]), ("c4", ["gone"])], "chunk_id string, urls array<string>")
    new = spark.createDataFrame([("n1", ["u2"])], "chunk_id string, urls array<string>")
    u = lambda *x: spark.createDataFrame([(v,) for v in x], "url string")
    assert [r[0] for r in rows(K.merge_chunks(chunks, new, u("u2"), u("u1", "u2", "u3")))] == ["c1", "c3", "n1"]
    cited = chunks.select("chunk_id", F.element_at("urls", 1).alias("source_url"), F.col("urls").alias("source_urls"))
    assert rows(K.uncovered(u("u1", "u2", "u9"), cited)) == [("u9",)]
    assert rows(K.parity(u("a", "b", None), u("b", "c"), "url")) == [("a", "missing"), ("c", "orphan")]


def test_snapshots(spark):
    pages = spark.createDataFrame([("a", "h1", None), ("b", None, "p"), ("c", "h3", "p3")], "url string, content_hash string, previous_content_hash string")
    u = lambda *x: spark.createDataFrame([(v,) for v in x], "url string")
    assert rows(K.snapshot(pages)) == [("a", "h1", "h1"), ("b", None, "p"), ("c", "h3", "h3")]
    assert rows(K.snapshot(pages, u("a", "b"))) == [("a", "h1", "h1"), ("b", None, "p"), ("c", "h3", "p3")]
    assert {r.url: r.previous_content_hash for r in K.clear_snapshot(pages, u("c")).collect()} == {"a": None, "b": "p", "c": None}


def test_plans(spark):
    a = spark.createDataFrame([("p", "1"), ("q", "2"), ("r", "3")], "k string, h string")
    b = spark.createDataFrame([("q", "2"), ("r", "x"), ("s", "9")], "k string, h string")
    assert rows(K.transfer_plan(a, b, "k", "h")) == [("p", "new"), ("q", "unchanged"), ("r", "updated"), ("s", "gone")]
    old = spark.createDataFrame([("p", ""), ("q", "w")], "k string, v string")
    new = spark.createDataFrame([("p", "1"), ("q", "2"), ("r", "3")], "k string, v string")
    assert rows(K.additive_merge(old, new, "k", "v")) == [("p", "1", "filled"), ("q", "w", "kept"), ("r", "3", "added")]


def test_components_and_frontier(spark):
    edges = [(f"n{i}", f"n{i + 1}") for i in range(40)] + [("x", "y"), ("y", "x"), ("z", "z"), (None, "x"), ("hub", "n3")] + [("hub2", f"s{i}") for i in range(30)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert {got[f"n{i}"] for i in range(41)} == {"hub"} and got["x"] == got["y"] == "x" and got["z"] == "z" and len({got[f"s{i}"] for i in range(30)}) == 1
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("b", "d"), ("d", None)], "source string, target string")
    seeds = spark.createDataFrame([("a",)], "node string")
    assert [rows(x) for x in K.frontier(links, seeds, 5)][:3] == [[("a", 0)], [("b", 1)], [("c", 2), ("d", 2)]]


def test_embedding_isolates_refused(spark):
    calls = []

    def embed(texts):
        calls.append(len(texts))
        if any("bad" in t for t in texts):
            raise Refused
        return [[float(len(t)), 1.0] for t in texts]

    assert embed_batch(["a", "bad", "cc", "d"], embed, delay=0) == [[1.0, 1.0], None, [2.0, 1.0], [1.0, 1.0]]
    state = {"n": 0}

    def flaky(texts):
        state["n"] += 1
        if state["n"] < 3:
            raise OSError
        return [[0.0]] * len(texts)

    assert embed_batch(["a"], flaky, delay=0) == [[0.0]]
    df = spark.createDataFrame([(1, "ab"), (2, None)], "id int, t string")
    out = embed_table(df, "id", "t", lambda ts: [[float(len(t))] for t in ts], size=1)
    assert sorted((r.id, r.embedding, r.failed) for r in out.collect()) == [(1, [2.0], False), (2, None, True)]


def test_id_parity_takes_all_documents(spark, tmp_path):
    for name, ids in (("review_labels", (1, 600, 700, None)), ("documents", (1, 600, 800))):
        spark.createDataFrame([(i,) for i in ids], "doc_id long").write.parquet(f"{tmp_path}/{name}.parquet")
    assert rows(corpus_queries.id_parity(spark, str(tmp_path))) == [(700, "missing"), (800, "orphan")]
