import random
import re

import numpy as np
import pyarrow as pa

from tidemark.llm import near_duplicates as nd

VOCAB = [f"w{i}" for i in range(400)] + ["straße", "día", "2024"]


def sets(text):
    words = re.findall(r"[^\W_]+", text.lower())
    return {tuple(words[i : i + 3]) for i in range(len(words) - 2)} if len(words) >= 30 else None


def brute(rows):
    docs = {i: s for i, t in rows if i is not None and t is not None and (s := sets(t)) is not None}
    ids = sorted(docs)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(docs[a] & docs[b]) * 10 >= 7 * len(docs[a] | docs[b])}


def corpus(rng):
    rows = []
    for i in range(60):
        base = [rng.choice(VOCAB) for _ in range(rng.randrange(25, 120))]
        rows.append((f"d{i:03d}", " ".join(base)))
        for k in range(rng.randrange(4)):
            edit = list(base)
            for _ in range(rng.randrange(0, 5)):
                p = rng.randrange(len(edit))
                edit[p : p + rng.randrange(2)] = [rng.choice(VOCAB)]
            rows.append((f"d{i:03d}v{k}", (", " if k else "  ").join(edit).upper()))
    return rows


def test_against_brute_force(spark):
    rows = corpus(random.Random(3))
    rows += [rows[0], ("copy1", rows[0][1]), ("copy2", rows[0][1] + "!"), ("n", None), ("e", ""), (None, rows[0][1]), ("long", " ".join(f"x{i}" for i in range(30000)))]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "chunk_id string, text string, a string, rep int")
    got = [(r.a, r.b) for r in nd.near_duplicate_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_empty(spark):
    assert nd.near_duplicate_pairs(spark.createDataFrame([], "chunk_id string, text string")).count() == 0


def test_blocks_and_sub_blocks_agree(monkeypatch):
    rng = np.random.default_rng(1)
    n = 4000
    row = rng.permutation(np.arange(1, n + 1)).astype(np.int64)
    column = (np.where(rng.random(n) < 0.3, 7, rng.integers(10, 900, n)) << 16) | 100
    order = np.lexsort((row, column))
    column, row = column[order], row[order]
    low, high, met = nd._multiply(column, row)
    whole = set(zip(low.tolist(), high.tolist()))
    monkeypatch.setattr(nd, "SUBBLOCK", 50)
    batches = [pa.RecordBatch.from_arrays([pa.array(column[i : i + 37]), pa.array(row[i : i + 37])], ["column", "row"]) for i in range(0, n, 37)]
    out = pa.Table.from_batches(list(nd._block(iter(batches)))).to_pylist()
    got = {(r["low"], r["high"]) for r in out if r["high"] is not None}
    hot = {r["low"]: r["met"] for r in out if r["high"] is None}
    assert hot == {7: int((column >> 16 == 7).sum())}
    of = {k: [(c, r) for c, r in zip(column.tolist(), row.tolist()) if c >> 16 == k] for k in hot}
    for k, members in of.items():
        parts = -(-len(members) // 50)
        for i in range(parts):
            for j in range(i, parts):
                cell = [(c, r, 2 if i == j else 0 if r % parts == i else 1) for c, r in members if r % parts in (i, j)]
                batch = pa.RecordBatch.from_pydict({"column": [x[0] for x in cell], "row": [x[1] for x in cell], "side": [x[2] for x in cell]})
                for b in nd._subblocks(iter([batch])):
                    got |= set(zip(b["low"].to_pylist(), b["high"].to_pylist()))
    assert got == whole


def test_recall_at_the_threshold():
    rng = np.random.default_rng(9)
    hit = 0
    for _ in range(300):
        x = rng.integers(0, 1 << 63, 340, np.uint64)
        a, b = x[:289], np.concatenate((x[51:], x[:0]))  # 238 of 340 in common: 0.7
        hit += bool(np.intersect1d(nd.bands(a), nd.bands(b)).size)
    assert hit >= 298


def test_groups_and_links_are_linear_in_the_input(spark):
    """A hot class of copies next to near ones: a row per text, one link between two classes, and all pairs follow from both."""
    base = [f"w{k}" for k in range(60)]
    near = base[:-1] + ["other"]
    rows = [(f"a{k:03}", " ".join(base)) for k in range(150)] + [(f"b{k}", " ".join(near)) for k in range(3)] + [("c", " ".join(f"z{k}" for k in range(40))), ("d", "too short"), ("e", None)]
    df = spark.createDataFrame([*rows, rows[0]], "chunk_id string, text string")
    groups = {r.chunk_id: (r.representative, r.links) for r in nd.near_duplicate_groups(df).collect()}
    assert len(groups) == 154 and groups["a149"] == ("a000", 1) and groups["b2"] == ("b0", 1) and groups["c"] == ("c", 0)
    assert [tuple(r) for r in nd.near_duplicate_links(df).collect()] == [("a000", "b0")]
    assert nd.near_duplicate_groups(df.limit(0)).count() == 0
