"""Texts to vectors through a pluggable embedder, with retries and isolation of texts that it refuses."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

BATCH, TRIES, DELAY = 100, 3, 5.0


class Refused(Exception):
    """The input itself is at fault; trying again is no use."""


def embed_batch(texts: list[str], embed: Callable[[list[str]], list[list[float]]], tries: int = TRIES, delay: float = DELAY) -> list[list[float] | None]:
    """A vector per text, null where the embedder refuses that text alone: a failing batch is halved until the bad texts are single."""
    for attempt in range(1, tries + 1):
        try:
            return list(embed(texts))
        except Refused:
            break
        except Exception:
            if attempt < tries:
                time.sleep(delay * attempt)
    if len(texts) == 1:
        return [None]
    half = len(texts) // 2
    return embed_batch(texts[:half], embed, tries, delay) + embed_batch(texts[half:], embed, tries, delay)


def embed_table(rows: DataFrame, key: str, text: str, embed: Callable[[list[str]], list[list[float]]], size: int = BATCH, tries: int = TRIES, delay: float = DELAY) -> DataFrame:
    """(key, embedding, failed): null texts fail without a call."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, size):
                part = batch.slice(i, size)
                texts = part.column(1).to_pylist()
                good = [k for k, t in enumerate(texts) if t is not None]
                vectors: list[list[float] | None] = [None] * len(texts)
                if good:
                    for k, v in zip(good, embed_batch([texts[k] for k in good], embed, tries, delay)):
                        vectors[k] = v
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(vectors, pa.list_(pa.float32())), pa.array([v is None for v in vectors])], [key, "embedding", "failed"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, text).mapInArrow(run, f"`{key}` {kind}, embedding array<float>, failed boolean")
