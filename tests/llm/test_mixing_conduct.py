import numpy as np
import pytest

from tidemark.llm import conduct, mixing

pytest.importorskip("public_tokenizers")


def test_knapsack_against_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n = rng.integers(1, 5)
        lengths, counts = np.sort(rng.choice(np.arange(1, 30), n, False)), rng.integers(1, 5, n)
        target = int(rng.integers(0, 80))
        sums = {0}
        for w, c in zip(lengths, counts):
            sums = {s + k * int(w) for s in sums for k in range(c + 1)}
        best = max(s for s in sums if s <= target)
        taken = mixing.fit_counts(lengths, counts, target)
        assert (taken <= counts).all() and int((taken * lengths).sum()) == best
        plan = mixing.plan_source(lengths, counts, 0, target)
        assert (plan <= counts).all() and int((plan * lengths).sum()) <= max(target, 0)


def test_mix(spark):
    docs = [(i, "word " * (1 + i % 37), ["Small Box", "big_box ", "unlisted"][0 if i % 10 == 0 else 1 if i % 10 < 8 else 2]) for i in range(1500)] + [(2000, None, "big_box"), (2001, "", "big_box"), (3, "word " * 4, "big_box"), (None, "x", "big_box")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, source string, repeats int")
    targets = spark.createDataFrame([("small_box", 0.3, 2), ("big_box", 0.7, 1), ("gone", 0.0, 1)], "source string, target_share double, max_repeats int")
    mixed, report = mixing.mix(df, targets)
    rows, shares = mixed.collect(), {r.source: r for r in report.collect()}
    assert len({r.doc_id for r in rows}) == len(rows) and all(r.repeats <= {"small_box": 2, "big_box": 1}[r.source] for r in rows)
    assert abs(shares["small_box"].actual_share - 0.3) < 1e-3 and abs(shares["big_box"].actual_share - 0.7) < 1e-3 and shares["gone"].tokens == 0
    again = mixing.mix(df.repartition(7), targets)[0].collect()
    assert {(r.doc_id, r.repeats) for r in rows} == {(r.doc_id, r.repeats) for r in again}
    empty, shares = mixing.mix(df.limit(0), targets)
    assert empty.count() == 0 and shares.count() == 3


def free(text):
    return conduct.features(text)[conduct.FEATURES.index("free_hits")]


def test_folding_and_frames():
    for t in ("You are a worthless m.o.r.o.n.", "Shut your mouth, you cl*wn", "cállate, 1d1074", "What a bаstаrd you are", "Kiss my assssss, board of losers.", "you s c u m", "Hey BAS-TARD, drop dead", "We know where your kids sleep.", "Foreigners belong in cages.", "Free porn clips", "Get lost, sccccumbag"):
        assert free(t) > 0, t
    for t in (None, "", "The complaint quotes the words 'you scum' and names the time.", "I felt like an idiot for missing March 3.", "The assistant assessed the class at the registration.", "Shoot the training video, then execute the contract.", "A caller said he would burn down the hall, the log shows.", "x" * 200_000):
        assert free(t) == 0, t


def test_trees_and_calibration():
    rng = np.random.default_rng(1)
    x = np.zeros((800, len(conduct.FEATURES)))
    y = (rng.random(800) < 0.1).astype(float)
    x[:, conduct.FEATURES.index("insult")] = y
    x[:, conduct.FEATURES.index("free_hits")] = y
    noisy = np.where(rng.random(800) < 0.03, 1 - y, y)
    p = conduct.Model(x, noisy).probability(x)
    assert ((p >= 0.5) == (y > 0)).all()
    steps, values = conduct.isotonic(rng.random(200), noisy[:200])
    assert (np.diff(values) >= 0).all() and (np.diff(steps) >= 0).all()


PLACES = "Oldtown Newbury Westford Eastvale Midmarsh".split()
BAD = ("You are a worthless moron of {}.", "We know where your kids sleep in {}.", "Foreigners belong in cages, says {}.", "Free porn clips from {}!!!")
GOOD = ("The office in {} opens at nine.", "The complaint quotes the words 'you scum' of {}.", "I felt like an idiot in {}.", "Trash bins stand in {}.", "Thank you for the help in {}.")


def judged(n, seed):
    rng = np.random.default_rng(seed)
    bad = rng.random(n) < 0.2
    texts = [str(rng.choice(BAD if b else GOOD)).format(rng.choice(PLACES)) for b in bad]
    return texts, bad


def test_held_out_documents_are_told_by_the_trees():
    texts, bad = judged(400, 2)
    x, rng = np.array([conduct.features(t) for t in texts]), np.random.default_rng(3)
    model = conduct.Model(x, np.where(rng.random(400) < 0.03, ~bad, bad).astype(float))
    held, truth = judged(300, 4)
    h = np.array([conduct.features(t) for t in held])
    assert ((model.probability(h) >= 0.5) == truth).mean() > 0.98
    # no rule stands beside the trees: without them every document has the same score
    model.trees.trees = []
    assert len(set(model.probability(h))) == 1


def test_dense_features_without_lexicon_words():
    f = dict(zip(conduct.FEATURES, conduct.features("YOU THERE!!! Do you see this? *** @@ ###")))
    assert f["caps"] > 0.3 and f["marks"] > 0 and f["you_rate"] > 0 and f["signs"] > 0 and f["free_hits"] == 0


def test_tables(spark):
    texts, bad = judged(200, 5)
    rows = [(10 + i, t, "c_d") for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(1, "You are a worthless moron of Oldtown.", "A B"), (2, "The office in Oldtown opens at nine.", None), (3, None, "a_b "), (4, "", "a_b"), *rows], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(1, None), *[(10 + i, int(b)) for i, b in enumerate(bad)]], "doc_id long, abusive int")
    found = {r.doc_id for r in conduct.find_abuse(docs, labels).collect()}
    assert found == {1} | {10 + i for i, b in enumerate(bad) if b}
    got = {r.source: (r.documents, r.flagged) for r in conduct.rates(docs, labels).collect()}
    assert got == {"a_b": (3, 1), None: (1, 0), "c_d": (200, int(bad.sum()))}
    assert conduct.find_abuse(docs.limit(0), labels.limit(0)).count() == 0
    assert conduct.find_abuse(docs, labels.limit(0)).count() == 0


def test_long_documents_never_go_over_their_part(spark, monkeypatch):
    monkeypatch.setattr(mixing, "WINDOW", 20)
    rng = np.random.default_rng(6)
    rows = [(i, "word " * int(rng.integers(1, 120)), "long_box" if i % 2 else "other_box") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("long_box", 0.2, 1), ("other_box", 0.8, 1)], "source string, target_share double, max_repeats int")
    mixed, report = mixing.mix(df, targets)
    shares = {r.source: r.actual_share for r in report.collect()}
    assert abs(shares["long_box"] - 0.2) < 0.002 and mixed.filter("source = 'long_box' and tokens > 20").count() > 10
