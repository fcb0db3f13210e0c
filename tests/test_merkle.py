import datetime as dt

import pytest

from tidemark.operators import merkle
from tidemark.operators.merkle import IncrementalRun, Superseded, changed_pages, depth_for

H = "ab" * 32
G = "cd" * 32
PAGES = "id long, url string, crawl_status string, content_hash string, previous_content_hash string, crawled_at timestamp, node long"


def page(i, now, before, status="crawled", day=1):
    return (i, f"u{i}", status, now, before, day and dt.datetime(2026, 1, day), 7)


def test_latest_row_and_hash_spellings(spark):
    rows = [
        page(1, H, None), page(2, H, ""), page(3, H, H), page(4, "SHA256:" + H.upper() + "\n", " " + H), page(5, None, H), page(6, "", None),
        page(7, G, H, "failed"), page(8, G, H, day=1), page(8, H, H, day=2), page(9, G, H, day=3), page(9, H, H, day=2), page(9, G, H, day=3),
        page(10, G, H, day=2), page(10, H, H, day=None), page(None, G, H), page(11, G, "sha256:"),
    ]
    found = changed_pages(spark.createDataFrame(rows, PAGES))
    assert sorted(r.page_id for r in found.collect()) == [1, 2, 9, 10, 11]


def test_empty_table(spark):
    assert changed_pages(spark.createDataFrame([], PAGES)).count() == 0


def test_depth():
    assert [depth_for(n) for n in (0, 64, 65, 1024, 1025)] == [0, 0, 1, 1, 2]


def test_runs_publish_once_and_survive_failure(spark, tmp_path):
    run = IncrementalRun(spark, f"file://{tmp_path}/state")
    make = lambda rows: spark.createDataFrame(rows, "k long, h string, key string")
    rows = [(i, f"h{i}", "x") for i in range(3000)]
    seen = lambda record: sorted(r.k for r in spark.read.parquet(record["path"] + "/output").collect())
    assert seen(run.run(make(rows), "k", "h", lambda d: d)) == list(range(3000))
    rows2 = [(i, "new" if i in (5, 2999) else h, k) for i, h, k in rows if i != 7] + [(9000, "h", "x")]

    def fails(d):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        run.run(make(rows2), "k", "h", fails)
    assert run.current()["version"] == 1
    assert seen(run.run(make(rows2), "k", "h", lambda d: d)) == [5, 2999, 9000]
    assert seen(run.run(make(rows2), "k", "h", lambda d: d)) == []


def test_a_crash_between_output_and_publishing_repeats_the_run(spark, tmp_path, monkeypatch):
    run = IncrementalRun(spark, f"file://{tmp_path}/state")
    make = lambda rows: spark.createDataFrame(rows, "k long, h string")
    run.run(make([(1, "a"), (2, "b")]), "k", "h", lambda d: d)
    publish = IncrementalRun._publish

    def lost(self, record):
        raise RuntimeError("lost")

    monkeypatch.setattr(IncrementalRun, "_publish", lost)
    with pytest.raises(RuntimeError):
        run.run(make([(1, "a"), (2, "c"), (3, "d")]), "k", "h", lambda d: d)
    monkeypatch.setattr(IncrementalRun, "_publish", publish)
    assert run.current()["version"] == 1
    record = run.run(make([(1, "a"), (2, "c"), (3, "d")]), "k", "h", lambda d: d)
    assert sorted(r.k for r in spark.read.parquet(record["path"] + "/output").collect()) == [2, 3] and record["changed"] == 2


def test_of_two_runs_at_once_one_is_superseded(spark, tmp_path):
    make = lambda rows: spark.createDataFrame(rows, "k long, h string")
    one, two = (IncrementalRun(spark, f"file://{tmp_path}/state") for _ in range(2))
    one.run(make([(1, "a")]), "k", "h", lambda d: d)

    def meanwhile(d):
        two.run(make([(1, "a"), (5, "e")]), "k", "h", lambda x: x)
        return d

    with pytest.raises(Superseded):
        one.run(make([(1, "b")]), "k", "h", meanwhile)
    assert one.current()["version"] == 2 and one.current()["records"] == 2
    record = one.run(make([(1, "b"), (5, "e")]), "k", "h", lambda d: d)
    assert [r.k for r in spark.read.parquet(record["path"] + "/output").collect()] == [1]


def test_removed_keys_are_told_and_only_changed_leaves_are_written(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(merkle, "MOST_PARTS", 3)
    run = IncrementalRun(spark, f"file://{tmp_path}/state")
    now = {i: f"h{i}" for i in range(2000)}
    make = lambda: spark.createDataFrame(list(now.items()), "k long, h string")
    assert run.run(make(), "k", "h", None)["changed"] == 0
    for step in range(1, 7):
        now[step] = f"new{step}"
        now[5000 + step] = "x"
        del now[100 + step]
        record = run.run(make(), "k", "h", lambda d: d)
        assert sorted(r.k for r in spark.read.parquet(record["path"] + "/output").collect()) == [step, 5000 + step]
        assert [r.key for r in spark.read.parquet(record["path"] + "/removed").collect()] == [100 + step] and record["removed"] == 1
        rows = spark.read.parquet(record["path"] + "/rows").count()
        assert rows == 2000 if len(record["parts"]) == 1 else rows < 600, step
    now = {i: h for i, h in now.items() if i % 2} | {i: "y" for i in range(10_000, 40_000)}  # the tree grows
    record = run.run(make(), "k", "h", lambda d: d.select("k"))
    assert record["changed"] == 30_000 and record["depth"] == 3


def test_pages_against_a_saved_state(spark, tmp_path):
    folder = f"file://{tmp_path}/pages"
    first = spark.createDataFrame([page(1, H, None), page(2, H, H), page(3, G, H)], PAGES)
    assert sorted(r.page_id for r in changed_pages(first, folder).collect()) == [1, 3]
    assert changed_pages(first, folder).count() == 0
    later = spark.createDataFrame([page(1, H, None), page(2, G, H), page(4, H, None)], PAGES)
    assert sorted(r.page_id for r in changed_pages(later, folder).collect()) == [2, 4]
