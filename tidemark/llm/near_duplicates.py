"""Near-duplicate texts by a blocked sparse matrix product of documents and n-grams.

Rows of the matrix are classes of texts with the same words. Single n-grams as columns make too many products: on text from
templates the rarest 30 % of a text's trigrams meet 3,800 times as many pairs as there are near-duplicates. So the columns are
compound n-grams, which is to say banded MinHash: BANDS columns per text, each made of ROWS minima of hash functions over the text's
distinct n-grams. Columns are dealt to blocks by hash; a block multiplies its columns and leaves out pairs whose sizes alone rule
out the threshold. How often a pair meets is not used to leave out more. The pairs of all blocks are verified exactly on the full
n-gram sets.

Two texts of similarity s share a column with probability 1 - (1 - s**ROWS)**BANDS if the columns' minima were independent. As
BANDS * ROWS picks share HASHES minima, it is less: measured 0.9992 at s = 0.7, and above 0.9999 at 0.8.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.materialize import materialize, small

#: Words per n-gram, least similarity, and words that a text must have.
WORDS, SIMILARITY, LEAST_WORDS = 3, (7, 10), 30
HASHES, ROWS, BANDS = 240, 7, 110
#: Bytes of columns that a block holds, about.
BLOCK_BYTES = 64 << 20
#: Columns with more rows are multiplied in sub-blocks of this size, spread over tasks.
SUBBLOCK = 2048
#: Copies of one text up to which all their pairs are given, and the product of two classes' sizes up to which all pairs
#: between them are; beyond, each copy is linked to its class's least id, and the least ids to each other's copies.
COPIES, PRODUCT = 64, 4096
#: Words and classes that a worker remembers.
CACHE = 500_000

_find = re.compile(r"[^\W_]+").findall
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
P = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of 64-bit values over all bits."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > CACHE:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


@lru_cache(1)
def _cache() -> _Words:
    return _Words()


def words_of(text: str) -> list[str]:
    """Runs of letters and digits of the lower-cased text."""
    return _find(text.lower())


def grams(words: list[str], n: int = WORDS) -> np.ndarray:
    """The distinct 64-bit hashes of n consecutive words, sorted; empty for fewer words than n."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_cache().__getitem__, words), np.uint64, len(words))
    total = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        total += mix(h[k : len(h) - n + 1 + k] * P[k % len(P)] + np.uint64(k))
    return np.unique(mix(total))


@lru_cache(1)
def _functions() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    a = (rng.integers(1, 1 << 32, HASHES, np.uint64) | np.uint64(1)).astype(np.uint32)
    b = rng.integers(0, 1 << 32, HASHES, np.uint64).astype(np.uint32)
    picks = np.stack([rng.permutation(HASHES)[:ROWS] for _ in range(BANDS)])
    salt = rng.integers(1, 1 << 63, (BANDS, ROWS), np.uint64) | np.uint64(1)
    return a[:, None], b[:, None], picks, salt


def bands(hashes: np.ndarray) -> np.ndarray:
    """The BANDS columns (64-bit) of a set of n-gram hashes."""
    a, b, picks, salt = _functions()
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 4096):
        np.minimum(least, (a * low[None, i : i + 4096] + b).min(axis=1), out=least)
    picked = least[picks].astype(np.uint64)
    return mix((mix(picked + np.uint64(1)) * salt).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))


def _class_of(words: list[str]) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(" ".join(words).encode())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) -> (id, h1, h2): the class of the text's words."""
    for batch in batches:
        ids, one, two = [], [], []
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = words_of(text)
            if len(words) >= LEAST_WORDS:
                h = _class_of(words)
                ids.append(i)
                one.append(h[0])
                two.append(h[1])
        yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(one, pa.int64()), pa.array(two, pa.int64())], ["id", "h1", "h2"])


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) -> (column, row): 48 bits of the column and the size of the set in 16; a class once per task."""
    seen: set[int] = set()
    for batch in batches:
        columns, rows = [], []
        for text in batch.column(1).to_pylist():
            words = words_of(text)
            if len(words) < LEAST_WORDS or (h := _class_of(words)[0]) in seen:
                continue
            if len(seen) > CACHE:
                seen.clear()
            seen.add(h)
            found = grams(words)
            size = np.uint64(min(len(found), 0xFFFF))
            columns.append((bands(found) & ~np.uint64(0xFFFF)) | size)
            rows.append(h)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(columns).view(np.int64)), pa.array(np.repeat(np.array(rows, np.int64), BANDS))], ["column", "row"])


def _multiply(column: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows that meet in columns (sorted), with how often; pairs are left out whose sizes rule the threshold out."""
    key, size = column >> 16, column & 0xFFFF
    lows, highs = [], []
    live = np.arange(len(key))
    step = 1
    while True:
        live = live[live + step < len(key)]
        live = live[key[live] == key[live + step]]
        if not len(live):
            break
        i, j = live, live + step
        small_, large = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
        good = (row[i] != row[j]) & ((small_ * SIMILARITY[1] >= large * SIMILARITY[0]) | (large == 0xFFFF))
        x, y = row[i[good]], row[j[good]]
        lows.append(np.minimum(x, y))
        highs.append(np.maximum(x, y))
        step += 1
    if not lows:
        return (np.empty(0, np.int64),) * 3
    low, high = np.concatenate(lows), np.concatenate(highs)
    order = np.lexsort((high, low))
    low, high = low[order], high[order]
    first = np.flatnonzero(np.concatenate(([True], (low[1:] != low[:-1]) | (high[1:] != high[:-1])))) if len(low) else np.empty(0, np.int64)
    return low[first], high[first], np.diff(np.append(first, len(low)))


def _block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(column, row) sorted by column -> (low, high, met). A column over SUBBLOCK rows comes out as (column key, null, rows)."""
    names = ["low", "high", "met"]
    rest_c, rest_r, hot, hot_n = np.empty(0, np.int64), np.empty(0, np.int64), None, 0

    def out(c: np.ndarray, r: np.ndarray) -> Iterator[pa.RecordBatch]:
        low, high, met = _multiply(c, r)
        if len(low):
            yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(high), pa.array(met.astype(np.int64))], names)

    def close() -> Iterator[pa.RecordBatch]:
        nonlocal hot, hot_n
        if hot is not None:
            yield pa.RecordBatch.from_arrays([pa.array([hot], pa.int64()), pa.array([None], pa.int64()), pa.array([hot_n], pa.int64())], names)
        hot, hot_n = None, 0

    for batch in batches:
        c = np.concatenate((rest_c, batch.column(0).to_numpy()))
        r = np.concatenate((rest_r, batch.column(1).to_numpy()))
        key = c >> 16
        if hot is not None:
            more = int(np.searchsorted(key, hot, "right"))
            hot_n += more
            c, r, key = c[more:], r[more:], key[more:]
            if not len(c):
                rest_c, rest_r = c, r
                continue
            yield from close()
        if not len(c):
            continue
        cut = int(np.searchsorted(key, key[-1], "left"))  # the last column may go on in the next batch
        edge = np.flatnonzero(np.concatenate(([True], key[1:cut] != key[: cut - 1]))) if cut else np.empty(0, np.int64)
        sizes = np.diff(np.append(edge, cut))
        big = np.flatnonzero(sizes > SUBBLOCK)
        keep = np.ones(cut, bool)
        for b in big:
            keep[edge[b] : edge[b] + sizes[b]] = False
            yield pa.RecordBatch.from_arrays([pa.array([key[edge[b]]], pa.int64()), pa.array([None], pa.int64()), pa.array([sizes[b]], pa.int64())], names)
        yield from out(c[:cut][keep], r[:cut][keep])
        rest_c, rest_r = c[cut:], r[cut:]
        if len(rest_c) > SUBBLOCK:
            hot, hot_n = int(rest_c[0] >> 16), len(rest_c)
            rest_c, rest_r = rest_c[:0], rest_r[:0]
    yield from close()
    if len(rest_c):
        yield from out(rest_c, rest_r)


def _subblocks(cells: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, i, j, column, row, side) with all rows of a cell together -> pairs between the sub-blocks i and j of a column."""
    table = pa.Table.from_batches(list(cells))
    if not table.num_rows:
        return
    c, r, side = table["column"].to_numpy(), table["row"].to_numpy(), table["side"].to_numpy()
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    for start in range(0, len(left), 256):
        i, j = np.meshgrid(left[start : start + 256], right, indexing="ij")
        i, j = i.ravel(), j.ravel()
        a, b = c[i] & 0xFFFF, c[j] & 0xFFFF
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        good = (r[i] < r[j]) if (side == 2).all() else (r[i] != r[j])
        good &= (lo * SIMILARITY[1] >= hi * SIMILARITY[0]) | (hi == 0xFFFF)
        x, y = r[i[good]], r[j[good]]
        if len(x):
            pair = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1]), pa.array(np.ones(pair.shape[1], np.int64))], ["low", "high", "met"])


def _hot_pairs(postings: DataFrame, hot: DataFrame) -> DataFrame:
    """The products of columns with very many rows: their rows are dealt to sub-blocks, and each pair of sub-blocks is a cell of its own."""
    rows = postings.distinct().withColumn("key", F.shiftright("column", 16)).join(F.broadcast(hot), "key")
    parts = F.ceil(F.col("n") / SUBBLOCK).cast("int")
    mine = F.pmod(F.xxhash64("row"), parts).cast("int")
    cells = rows.withColumn("parts", parts).withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = cells.select(
        "key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "column", "row",
        F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1).alias("side"),
    )
    return cells.groupBy("key", "i", "j").applyInArrow(lambda t: pa.Table.from_batches(list(_subblocks(iter(t.to_batches()))), schema=_PAIRS), "low bigint, high bigint, met bigint")


_PAIRS = pa.schema([("low", pa.int64()), ("high", pa.int64()), ("met", pa.int64())])


def candidate_pairs(texts: DataFrame, count: int = 0) -> DataFrame:
    """(low, high): pairs of classes (first hashes) that share columns. texts: (id, text), not null; count: how many there are, about."""
    parts = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-count * BANDS * 16 // BLOCK_BYTES))
    postings = texts.mapInArrow(_postings, "column bigint, row bigint")
    blocks = postings.repartition(parts, F.shiftright("column", 16)).sortWithinPartitions("column", "row")
    products = materialize(blocks.mapInArrow(_block, "low bigint, high bigint, met bigint"), "products")
    pairs = products.filter(F.col("high").isNotNull())
    hot = products.filter(F.col("high").isNull()).select(F.col("low").alias("key"), F.col("met").alias("n"))
    if hot.count():
        pairs = pairs.unionByName(_hot_pairs(postings, hot))
    return pairs.select("low", "high").distinct()


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, text_a, text_b) -> (a, b, common, size_a, size_b) of the pairs that reach the similarity, on the full sets."""
    for batch in batches:
        rows, sets = [], {}
        for a, b, x, y in zip(*(batch.column(k).to_pylist() for k in range(4))):
            for i, t in ((a, x), (b, y)):
                if i not in sets:
                    sets[i] = grams(words_of(t))
            m, n = sets[a], sets[b]
            common = len(np.intersect1d(m, n, assume_unique=True))
            if common * SIMILARITY[1] >= SIMILARITY[0] * (len(m) + len(n) - common):
                rows.append((a, b))
        kind = batch.schema.field(0).type
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows], kind)], ["a", "b"])


def _prepared(rows: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    texts = rows.select(F.col(key).alias("id"), F.col(text).alias("text")).filter(F.col("id").isNotNull() & F.col("text").isNotNull())
    kind = texts.schema["id"].dataType.simpleString()
    members = materialize(texts.mapInArrow(_classes, f"id {kind}, h1 bigint, h2 bigint").distinct(), "classes")
    return texts, members


def near_duplicates(rows: DataFrame, key: str = "chunk_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(members, links): members (id, rep) of each text of LEAST_WORDS words or more, where rep is the least id with the same words,
    and links (a, b) between representatives of different texts, a < b, whose n-gram sets reach SIMILARITY.
    """
    texts, members = _prepared(rows, key, text)
    reps = members.groupBy("h1", "h2").agg(F.min("id").alias("rep"))
    pairs = materialize(candidate_pairs(texts, members.count()), "pairs")
    wanted = pairs.select(F.col("low").alias("h1")).unionByName(pairs.select(F.col("high").alias("h1"))).distinct()
    involved = materialize(reps.join(small(materialize(wanted, "wanted")), "h1", "left_semi").select("h1", "rep"), "involved")
    found = texts.join(small(involved), texts["id"] == involved["rep"]).select("h1", "rep", "text").dropDuplicates(["rep"])
    found = materialize(found, "texts")
    left = found.select(F.col("h1").alias("low"), F.col("rep").alias("x"), F.col("text").alias("text_x"))
    right = found.select(F.col("h1").alias("high"), F.col("rep").alias("y"), F.col("text").alias("text_y"))
    both = pairs.select("low", "high").join(left, "low").join(right, "high")
    kind = found.schema["rep"].dataType.simpleString()
    links = both.select("x", "y", "text_x", "text_y").mapInArrow(_verify, f"a {kind}, b {kind}").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    named = members.join(reps, ["h1", "h2"]).select("id", "rep")
    return named, links


def near_duplicate_groups(rows: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """(key, representative, links): a row per text of LEAST_WORDS words or more: the least id with the same words, and to how many other
    classes its class is linked. The size of the result is that of the input, however many copies a text has.

    An id delivered twice with the same words is one row; null and shorter texts have none; an empty table gives no rows.
    """
    members, links = near_duplicates(rows, key, text)
    links = materialize(links, "links")
    ends = links.select(F.col("a").alias("rep")).unionByName(links.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count("*").alias("links"))
    return members.join(ends, "rep", "left").select(F.col("id").alias(key), F.col("rep").alias("representative"), F.coalesce("links", F.lit(0)).alias("links"))


def near_duplicate_links(rows: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """(a, b), a < b: the links between the representatives of classes of different words that reach SIMILARITY; with
    near_duplicate_groups() these are all pairs, copies not expanded."""
    return near_duplicates(rows, key, text)[1].distinct()


def near_duplicate_pairs(rows: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """(a, b), a < b, of different ids whose texts reach SIMILARITY in distinct runs of WORDS words.

    Texts with fewer than LEAST_WORDS words and null texts are left out; an id delivered twice is one row; ties don't occur, since
    every pair counts; an empty table gives no rows; other columns don't matter. Of texts with the same words, all pairs are given up
    to COPIES copies, and beyond that each copy's pair with the least id. Between two different texts, all pairs of their copies
    are given up to PRODUCT pairs, and beyond that those of either's least id, so that no link between different texts is lost.
    """
    members, links = near_duplicates(rows, key, text)
    members, links = materialize(members, "members"), materialize(links, "links")
    sizes = members.groupBy("rep").agg(F.count("*").alias("n"))
    several = materialize(members.join(sizes.filter("n > 1"), "rep"), "copies")
    few = several.filter(F.col("n") <= COPIES)
    within = few.select("rep", F.col("id").alias("a")).join(few.select("rep", F.col("id").alias("b")), "rep").filter("a < b").select("a", "b")
    star = several.filter((F.col("n") > COPIES) & (F.col("id") != F.col("rep"))).select(F.col("rep").alias("a"), F.col("id").alias("b"))
    linked = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).select(F.col("a").alias("rep")).distinct()
    inside = several.join(linked, "rep", "left_semi")
    counts = inside.select("rep", "n").distinct()
    plain = links.join(counts.select(F.col("rep").alias("a"), F.col("n").alias("na")), "a", "left").join(counts.select(F.col("rep").alias("b"), F.col("n").alias("nb")), "b", "left")
    plain = plain.select("a", "b", F.coalesce("na", F.lit(1)).alias("na"), F.coalesce("nb", F.lit(1)).alias("nb"))
    left = inside.select(F.col("rep").alias("a"), F.col("id").alias("x"))
    right = inside.select(F.col("rep").alias("b"), F.col("id").alias("y"))
    spread = plain.filter((F.col("na") * F.col("nb") > 1) & (F.col("na") * F.col("nb") <= PRODUCT)).join(left, "a", "left").join(right, "b", "left")
    spread = spread.select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b"))
    wide = plain.filter(F.col("na") * F.col("nb") > PRODUCT)
    rays = wide.join(left, "a", "left").select(F.coalesce("x", "a").alias("a"), "b").unionByName(wide.join(right, "b", "left").select("a", F.coalesce("y", "b").alias("b")))
    across = plain.filter("na * nb = 1").select("a", "b").unionByName(spread).unionByName(rays)
    ordered = across.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return within.unionByName(star).unionByName(ordered).distinct()
