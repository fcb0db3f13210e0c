"""Encoding of a corpus with the byte-level BPE of a public tokenizer.

Pre-tokenisation works on arrays of code points, not with a regular expression. Each code point has a class (letter, number,
white space, other, end of text); whether a piece starts at a position follows from the classes at and around it, from the
length of its run and from whether the run's first character was taken by a preceding space. A run's state depends on nothing
but its neighbours, so the scan over transition functions collapses to maxima over positions, which numpy computes for a whole
batch at once. Pieces then go through a cache to the merges; what a piece merges to is kept in flat arrays with offsets, by
which the ids of a batch are gathered.
"""

from __future__ import annotations

import base64
import heapq
import os
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Where the vocabulary files are, unless a path is given.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
LETTER, NUMBER, SPACE, OTHER, END = range(5)
#: White space of the pattern's \s (fixed values of the Unicode property White_Space).
WHITE = (0x9, 0xA, 0xB, 0xC, 0xD, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: Code points handled at once, and pieces kept in the cache.
BATCH, CACHE = 2_000_000, 400_000
#: Longer pieces are merged with a heap and not kept.
LONG = 64


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of every code point."""
    names = np.frombuffer("".join(map(unicodedata.category, map(chr, range(sys.maxunicode + 1)))).encode(), "S2")
    major = names.astype("S1")
    out = np.full(len(names), OTHER, np.uint8)
    out[major == b"L"], out[major == b"N"], out[list(WHITE)] = LETTER, NUMBER, SPACE
    return out


@lru_cache(4)
def ranks(path: str) -> dict[bytes, int]:
    """The rank file: bytes -> id, which is also the priority of merges."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(piece: bytes, table: dict[bytes, int]) -> list[int]:
    """The ids of a piece: join the neighbours of lowest rank, the leftmost first, until none can be joined."""
    if (whole := table.get(piece)) is not None:
        return [whole]
    parts = [piece[i : i + 1] for i in range(len(piece))]
    if len(parts) > LONG:
        return _merge_long(parts, table)
    while len(parts) > 1:
        best, at = None, 0
        for i in range(len(parts) - 1):
            r = table.get(parts[i] + parts[i + 1])
            if r is not None and (best is None or r < best):
                best, at = r, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [table[p] for p in parts]


def _merge_long(parts: list[bytes], table: dict[bytes, int]) -> list[int]:
    """The same in n log n, with a linked list and a heap of (rank, position)."""
    n = len(parts)
    left, right, here = list(range(-1, n - 1)), list(range(1, n + 1)), list(parts)
    heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := table.get(parts[i] + parts[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = right[i] if here[i] is not None else n
        if j >= n or here[i] != a or here[j] != b:
            continue
        here[i], here[j] = a + b, None
        right[i] = right[j]
        if right[i] < n:
            left[right[i]] = i
        for x, y in ((left[i], i), (i, right[i])):
            if x >= 0 and y < n and (r := table.get(here[x] + here[y])) is not None:
                heapq.heappush(heap, (r, x, here[x], here[y]))
    return [table[p] for p in here if p is not None]


def starts(points: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """The positions at which pieces start. kinds: the class of each code point, END between texts and at the end."""
    n = len(points)
    run = np.empty(n, bool)
    run[0] = True
    np.not_equal(kinds[1:], kinds[:-1], out=run[1:])
    run |= kinds == END
    begin = run.copy()
    # white space before something else: its last character stands alone, or is joined to what follows if it is a plain space
    last = np.flatnonzero((kinds[:-1] == SPACE) & (kinds[1:] < END) & (kinds[1:] != SPACE))
    begin[last] = True
    begin[last[points[last] == 0x20] + 1] = False
    # contractions: an apostrophe alone in its run at the start of a piece, followed by s, t, m, d, re, ve or ll
    mark = np.flatnonzero((points[:-1] == 0x27) & begin[:-1] & (kinds[1:] == LETTER) & run[:-1])
    if len(mark):
        padded = np.concatenate((points, [0, 0]))
        a, b = padded[mark + 1], padded[mark + 2]
        short = (a == ord("s")) | (a == ord("t")) | (a == ord("m")) | (a == ord("d"))
        long = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        size = np.where(short, 2, np.where(long, 3, 0))
        mark, size = mark[size > 0], size[size > 0]
        begin[mark + 1] = False
        after = mark + size
        begin[after[after < n]] = True
    return np.flatnonzero(begin)


class Encoder:
    """Encodes batches of texts; one per Python worker."""

    def __init__(self, path: str) -> None:
        self.table = ranks(path)
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.used = np.empty(1 << 16, np.int32), 0
        self.at: list[int] = []
        self.size: list[int] = []

    def add(self, piece: str) -> int:
        ids = merge(piece.encode(), self.table)
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.empty(len(self.flat) + len(ids), np.int32)))
        self.flat[self.used : self.used + len(ids)] = ids
        self.at.append(self.used)
        self.size.append(len(ids))
        self.used += len(ids)
        if len(piece) <= LONG:
            self.index[piece] = len(self.at) - 1
        return len(self.at) - 1

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's ids end (with a leading 0)."""
        if len(self.at) > CACHE:
            self.forget()
        joined = "\0".join(texts) + "\0"
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
        kinds = classes()[points]
        kinds[ends] = END
        begin = starts(points, kinds)
        marks = np.searchsorted(begin, ends)  # the separators are pieces of their own
        index = self.index
        bounds = begin.tolist()
        bounds.append(len(joined))
        index_of, add = index.get, self.add
        pieces = [joined[a:b] for a, b in zip(bounds, bounds[1:])]
        found = [i if (i := index_of(p)) is not None else add(p) for p in pieces]
        which = np.array(found, np.int64)
        size = np.array(self.size, np.int64)[which]
        size[marks] = 0
        at = np.array(self.at, np.int64)[which]
        total = np.concatenate(([0], np.cumsum(size)))
        gathered = np.repeat(at - total[:-1], size) + np.arange(total[-1])
        return self.flat[gathered], np.concatenate(([0], total[marks]))


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _groups(texts: list[str]) -> Iterator[list[str]]:
    group, size = [], 0
    for t in texts:
        if group and size + len(t) > BATCH:
            yield group
            group, size = [], 0
        group.append(t)
        size += len(t)
    if group:
        yield group


def encode_lists(texts: list[str | None], path: str) -> pa.ListArray:
    """A list of ids per text; null and empty texts have none."""
    ids, ends, base = [np.empty(0, np.int32)], [np.zeros(1, np.int64)], 0
    for group in _groups([t or "" for t in texts]):
        values, stops = encoder(path).encode(group)
        ids.append(values)
        ends.append(stops[1:] + base)
        base += len(values)
    return pa.ListArray.from_arrays(pa.array(np.concatenate(ends).astype(np.int32)), pa.array(np.concatenate(ids)))


def encode_table(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, ids) of each row: the token ids of its text, without special tokens.

    Null and empty texts give an empty list; strings that look like special tokens are ordinary text. No shuffle; rows stay as
    they are, repeated ones and ties included, and an empty table gives no rows.
    """
    path = path or f"{TOKENIZERS}/byte_bpe_50k.tiktoken"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
                ids = encode_lists(part.column(1).to_pylist(), path)
                yield pa.RecordBatch.from_arrays([part.column(0), ids], [key, "ids"])

    rows = documents.select(key, text)
    kind = rows.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def count_table(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """(key, keep..., tokens): the number of token ids of each row's text, 0 for null and empty texts."""
    path = path or f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
    keep = keep or []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
                texts = [t or "" for t in part.column(0).to_pylist()]
                sizes = [np.diff(encoder(path).encode(g)[1]) for g in _groups(texts)]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(np.concatenate(sizes))], [key, *keep, "tokens"])

    rows = documents.select(text, key, *keep)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(run, f"{kinds}, tokens bigint")


def decode(ids: list[int], path: str | None = None) -> str:
    """The text of a list of ids; bytes that are no UTF-8 are replaced."""
    back = _reverse(path or f"{TOKENIZERS}/byte_bpe_50k.tiktoken")
    return b"".join(back[i] for i in ids).decode("utf-8", "replace")


@lru_cache(2)
def _reverse(path: str) -> dict[int, bytes]:
    return {i: b for b, i in ranks(path).items()}
