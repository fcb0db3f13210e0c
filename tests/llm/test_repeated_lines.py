import re
from collections import defaultdict

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import repeated_lines as rl

SCHEMA = "chunk_id string, source_url string, text string, site string, line string, n int"


def brute(rows):
    docs, per = {}, defaultdict(set)
    for cid, url, text in rows:
        m = re.match(r"[a-z]+://(?:www\.)?([^/?#]*)", (url or "").lower())
        if m and cid:
            docs[cid] = (m[1], text)
    for cid, (s, _) in docs.items():
        per[s].add(cid)
    key = lambda line: "".join(c for c in line if c.isalpha()).lower()
    has = defaultdict(set)
    for cid, (s, text) in docs.items():
        for line in (text or "").split("\n") if text is not None else []:
            has[s, key(line)].add(cid)
    good = {k for k, v in has.items() if len(k[1]) >= 12 and len(v) >= 5 and len(v) >= 0.05 * len(per[k[0]])}
    return sorted((cid, i) for cid, (s, text) in docs.items() if text is not None for i, line in enumerate(text.split("\n")) if (s, key(line)) in good)


def corpus():
    rows = []
    for i in range(400):
        host = ["https://www.A.example/x", "http://a.example/y#f", "https://b.example/q?z=1"][i % 3]
        own = f"own line number {'x' * (i % 17)} {chr(97 + i % 26)}{chr(97 + i // 26)} of this page"
        lines = [own, "", "Share THIS page, friends!" if i % 9 == 0 else "short 12", "Footer of the site 2024" if i % 25 else "footer OF the site 1999"]
        rows.append((f"{i:032x}", host, "\n".join(lines)))
    return rows + [rows[5], rows[5], ("n1", None, "Footer of the site"), ("n2", "https://a.example/", None), ("n3", "https://a.example/", ""), (None, "https://a.example/", "Footer of the site")]


def found(spark, rows):
    df = spark.createDataFrame([(*r, "s", "l", 1) for r in rows], SCHEMA)
    return sorted((r.chunk_id, r.line_no) for r in rl.find_repeated_lines(df).collect())


def test_against_brute_force(spark):
    assert found(spark, corpus()) == brute(corpus())


def test_few_counters_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(rl, "COUNTERS", 3)
    table, lowered = rl._reduced(pa.table({"site": ["s"] * 6, "line": [1, 2, 3, 4, 4, 5], "n": [1, 5, 4, 2, 1, 2]}))
    assert lowered == {"s": 2} and dict(zip(table["line"].to_pylist(), table["n"].to_pylist())) == {2: 3, 3: 2, 4: 1}
    sink = spark.createDataFrame([(*r, "s", "l", 1) for r in corpus()], SCHEMA)
    keyed = rl.materialize(rl.keyed_lines(sink))
    full = sorted((r.site, r.line) for r in rl.repeated_lines(keyed).collect())
    assert full and [len(full)] == [len({*full})]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 30)), min_size=1, max_size=300), st.integers(1, 8))
def test_summary_bound(pairs, counters):
    """What a summary lacks of a count is at most what it says."""
    before, rl.COUNTERS = rl.COUNTERS, counters
    try:
        batches = [pa.RecordBatch.from_pydict({"site": [s], "keys": pa.array([[k]], pa.list_(pa.int64()))}) for s, k in pairs]
        out = pa.Table.from_batches(list(rl._summaries(iter(batches)))).to_pylist()
    finally:
        rl.COUNTERS = before
    under = {r["site"]: r["n"] for r in out if r["line"] is None}
    kept = {(r["site"], r["line"]): r["n"] for r in out if r["line"] is not None}
    for p in set(pairs):
        assert kept.get(p, 0) <= pairs.count(p) <= kept.get(p, 0) + under[p[0]]


def test_empty_and_cleaned(spark):
    assert found(spark, []) == []
    df = spark.createDataFrame([(*r, "s", "l", 1) for r in corpus()], SCHEMA)
    cleaned = {r.chunk_id: r for r in rl.without_repeated_lines(df).collect()}
    gone = defaultdict(set)
    for cid, i in brute(corpus()):
        gone[cid].add(i)
    for cid, _, text in corpus():
        if cid is None:
            continue
        want = None if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone[cid])
        assert cleaned[cid].text == want
