"""URL columns. Null and unusable URLs give null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Content types by file extension; everything else is html.
DOCUMENTS = ("pdf", "docx", "doc", "xls", "xlsx", "csv")


def part(url: Column, name: str) -> Column:
    """Scheme, host, path, query or fragment of a URL, by RFC 3986's own pattern."""
    index = {"scheme": 2, "host": 4, "path": 5, "query": 7, "fragment": 9}[name]
    return F.regexp_extract(url, r"^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?", index)


def normalized(url: Column, upgrade: tuple[str, ...] = (), blocked: tuple[str, ...] = ()) -> Column:
    """One spelling of an absolute URL: trimmed, without fragment, host in lower case, query parameters sorted, blank values kept.

    Hosts in `upgrade` get https; URLs of other schemes, without a host or with a host that contains one of `blocked` are null.
    """
    u = F.trim(url)
    scheme, host = F.lower(part(u, "scheme")), F.lower(part(u, "host"))
    query = F.array_join(F.array_sort(F.filter(F.split(part(u, "query"), "&"), lambda p: p != "")), "&")
    secure = F.when(host.isin(*upgrade), F.lit("https")).otherwise(scheme) if upgrade else scheme
    out = F.concat(secure, F.lit("://"), host, part(u, "path"), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    bad = F.lit(False)
    for b in blocked:
        bad = bad | host.contains(b)
    return F.when(scheme.isin("http", "https") & (host != "") & ~bad, out)


def content_type(url: Column) -> Column:
    """By the extension of the path."""
    extension = F.lower(F.regexp_extract(part(url, "path"), r"\.([^./]+)$", 1))
    return F.when(extension.isin(*DOCUMENTS), extension).otherwise("html")


def document_key(url: Column) -> Column:
    """The key under which a document's links are one: before `#` and `?`, without closing slashes, percent-decoded (a plus stays), lower case."""
    bare = F.regexp_replace(F.substring_index(F.substring_index(url, "#", 1), "?", 1), "/+$", "")
    return F.lower(F.coalesce(F.try_url_decode(F.replace(bare, F.lit("+"), F.lit("%2B"))), bare))


def is_internal(url: Column, domain: str) -> Column:
    return F.lower(part(url, "host")).contains(domain)


def first_match(value: Column, rules: list[tuple[str, str]]) -> Column:
    """The label of the first (pattern, label) that is found in the value, case ignored; null if none is."""
    out = None
    for pattern, label in rules:
        found = value.rlike(f"(?i){pattern}")
        out = F.when(found, label) if out is None else out.when(found, label)
    return out
