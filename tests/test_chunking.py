from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions import urls as U
from tidemark.operators import chunking as C


def one(spark, column, *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(column(F.col("v"))).collect()]


def test_words_and_sentences(spark):
    assert one(spark, T.word_count, None, "", " \t\n", "a b  c") in ([None, 0, 0, 3], [-1, 0, 0, 3])
    assert one(spark, T.sentences, "One two. Three four! no. Énd? Yes", "A. B") == [["One two.", "Three four! no. Énd?", "Yes"], []]
    assert one(spark, T.body, "[cap]\nrest\nmore", "[cap]", "no [cap]", "[x] y\nz") == ["rest\nmore", "", "no [cap]", "[x] y\nz"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 400), max_size=60))
def test_pack(sizes):
    ranges = C.pack(sizes, 300, 60)
    assert [r for r in ranges if r[0] >= r[1]] == [] and sorted({i for a, b in ranges for i in range(a, b)}) == list(range(len(sizes)))
    for (a, b), (c, _) in zip(ranges, ranges[1:]):
        assert a <= c <= b and sum(sizes[c:b]) <= 60 and (c == a or sum(sizes[c - 1 : b]) > 60)
    for a, b in C.group(sizes, 200, 1000):
        assert sum(sizes[a : b - 1]) + b - 1 - a <= 1000 or sum(sizes[a : b - 1]) < 1000 + 400


def test_row_group_edges():
    assert C.group([199], 200, 1000) == [(0, 1)] and C.group([150, 900], 200, 1000) == [(0, 2)] and C.group([250, 800], 200, 1000) == [(0, 1), (1, 2)] and C.group([250, 749], 200, 1000) == [(0, 2)] and C.group([], 1, 2) == []


def test_caps(spark):
    long = " ".join(["word"] * 700)
    rows = spark.createDataFrame([(1, "x" * 45_000), (2, long), (3, None), (4, " "), (5, "  Two words.  "), (6, "Short one here. " * 200)], "id long, t string")
    got = {r.id: r.pieces for r in C.semantic(rows, "t").collect()}
    assert [len(p) for p in got[1]] == [20000, 20000, 5002] and [len(p.split()) for p in got[2]] == [500, 200] and got[3] == [] and got[4] == [] and got[5] == ["Two words."]
    assert len(got[6]) > 1 and all(len(p.split()) <= 303 for p in got[6])
    tail = "\n".join([" ".join(["w"] * 240)] + [" ".join(["v"] * 20)])
    got = [r.pieces for r in C.paragraphs(spark.createDataFrame([(tail,), (None,), ("one\n\ntwo",)], "t string"), "t").collect()]
    assert len(got[0]) == 1 and got[1] == [] and got[2] == ["one\n\ntwo"]


def test_captions(spark):
    rows = [("Title", "Part", "Text here"), ("Title", "Title", "Text"), (None, "P", "T"), ("Title", "a.pdf", "Text"), ("Title", "Part", "title: more"), ("Title", "Part", "titles more"), ("T", "P", "[x] y"), ("T", "P", None)]
    df = spark.createDataFrame(rows, "t string, l string, x string").select(C.captioned(F.col("t"), F.col("l"), F.col("x")))
    assert [r[0] for r in df.collect()] == ["[Title — Part]\nText here", "[Title]\nText", "T", "[Title]\nText", "title: more", "[Title — Part]\ntitles more", "[x] y", None]


def test_language(spark):
    es = "la boleta de la votante en el condado para que se reciba por correo " * 4
    both = es + "the ballot of the voter in the county is to be mailed and you must sign it by the date " * 4
    assert one(spark, T.is_spanish, es, both, "la de", None) == [True, False, False, None]
    assert one(spark, T.is_foreign, "й" * 14, "й" * 15, "й" * 15 + "a" * 135, "й" * 15 + "a" * 134) == [False, True, False, True]


def test_urls(spark):
    n = lambda u: U.normalized(u, upgrade=("h.example",), blocked=("x.com",))
    assert one(spark, n, " HTTP://H.example/A?b=2&a=1&c=#f", "mailto:a@b", "https://netflix.com/", None, "//h/x") == ["https://h.example/A?a=1&b=2&c=", None, None, None, None]
    assert one(spark, U.content_type, "https://h/a.PDF?x=1.doc", "https://h/a.b/c", "https://h/x.xlsm") == ["pdf", "html", "html"]
    assert one(spark, U.document_key, "https://H/a%20b+c/?q#f", "bad%zz") == ["https://h/a b+c", "bad%zz"]
