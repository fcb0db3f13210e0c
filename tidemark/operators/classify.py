"""Classes of pages by an ordered list of signals; the signals are parameters."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.operators import routing

#: Characters of a text that are looked at; words from which a page is prose, or more than a short one; rows of tables that make a table page (fixed values).
SEEN, PROSE_WORDS, SHORT_WORDS, TABLE_ROWS = 2000, 500, 150, 5
#: Strategy of each class.
STRATEGIES = {
    "junk": "skip", "nav_hub": "single", "faq": "qa_pairs", "press_release": "simple", "location_list": "single", "table_data": "table_rows", "form": "simple", "prose": "semantic", "short_static": "single", "document": "document",
}


@dataclass
class Signals:
    """Patterns (Java regular expressions over lower-cased values) in the order in which they are tried."""

    junk: str = "$^"
    link_index: str = "$^"
    faq: str = "$^"
    faq_path: str = "$^"
    press: str = "$^"
    location: str = "$^"
    table: str = "$^"
    form: str = "$^"
    banners: list[str] = field(default_factory=list)


def page_class(url: Column, title: Column, text: Column, words: Column, content_type: Column, faq_shape: Column, table_rows: Column, s: Signals) -> Column:
    """The class of a page, the first that fits: junk, link index, FAQ by address and title or by path, press by all three, location, table,
    form, prose by length, short page, FAQ or table by its markup (faq_shape, table_rows), hub. Documents have their own class. Nulls count as empty."""
    u, t = F.lower(F.coalesce(url, F.lit(""))), F.lower(F.coalesce(title, F.lit("")))
    body = F.substring(F.lower(F.coalesce(routing.without_banner(text, s.banners), F.lit(""))), 1, SEEN)
    both, n = F.concat_ws(" ", u, t), F.coalesce(words, F.lit(0))
    html = content_type == "html"
    return (
        F.when(~html, "document").when(u.rlike(s.junk), "junk").when(u.rlike(s.link_index), "nav_hub").when(both.rlike(s.faq) | u.rlike(s.faq_path), "faq")
        .when(both.rlike(s.press) | body.rlike(s.press), "press_release").when(u.rlike(s.location), "location_list").when(u.rlike(s.table), "table_data").when(both.rlike(s.form), "form")
        .when(n >= PROSE_WORDS, "prose").when((n < SHORT_WORDS) & ~F.coalesce(faq_shape, F.lit(False)) & (F.coalesce(table_rows, F.lit(0)) < TABLE_ROWS), "short_static")
        .when(F.coalesce(faq_shape, F.lit(False)), "faq").when(F.coalesce(table_rows, F.lit(0)) >= TABLE_ROWS, "table_data").otherwise("nav_hub")
    )


def strategy(kind: Column, words: Column) -> Column:
    """The chunking strategy of a class; a page without words that is no junk is skipped."""
    by_class = F.create_map(*[x for pair in STRATEGIES.items() for x in map(F.lit, pair)])
    return F.when((F.coalesce(words, F.lit(0)) == 0) & ~kind.isin("junk", "document"), "skip").otherwise(F.try_element_at(by_class, kind))
