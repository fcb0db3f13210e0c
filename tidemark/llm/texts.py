"""Columns and batch helpers that the text operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def site(url: Column) -> Column:
    """The host of a URL, lower-cased and without a leading `www.`; null where the URL is null or has no host."""
    host = F.regexp_extract(F.lower(F.trim(url)), r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)
    bare = F.regexp_replace(host, r"^www\.", "")
    return F.when(bare != "", bare)


def lines(text: Column) -> Column:
    """The lines of a text: what `\\n` separates, blank ones included; null for null, one empty line for an empty text."""
    return F.split(text, "\n", -1)


def one_delivery(rows: DataFrame, key: str, *columns: str) -> DataFrame:
    """A row per key with the given columns; deliveries of one key are taken to agree. Rows without a key are left out."""
    return rows.filter(F.col(key).isNotNull()).select(key, *columns).dropDuplicates([key])
