"""Text columns: white space, words, sentences, letters, language. All stay in the JVM.

Null gives null throughout, an empty or blank text has zero words and no sentences.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space in the Unicode sense, as \s of Java is ASCII only.
WHITE = r"(?U)\s+"
#: Function words by which Spanish and English are told apart (fixed values).
SPANISH = "el la los las de del para por con una uno que es en su se como más este esta votación elección boleta votante condado estado fecha correo electoral".split()
ENGLISH = "the of to and in is for you your that are be will on with must may by or if".split()
#: From how many words, from which share of Spanish words and below which share of English ones a text is Spanish.
SPANISH_WORDS, SPANISH_SHARE, ENGLISH_SHARE = 30, 0.20, 0.05
#: From how many letters beyond Latin, and above which share of all letters, a text is of another script.
FOREIGN_LETTERS, FOREIGN_SHARE = 15, 0.10


def squeezed(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, WHITE, " "))


def stripped(text: Column) -> Column:
    """Without white space at the ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def words(text: Column) -> Column:
    """The runs of other than white space."""
    return F.filter(F.split(squeezed(text), " "), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def sentences(text: Column) -> Column:
    """Pieces between `.`, `!` or `?` and an ASCII capital, of more than two characters, white space squeezed."""
    return F.filter(F.split(squeezed(text), r"(?<=[.!?]) (?=[A-Z])"), lambda s: F.length(s) > 2)


def body(text: Column) -> Column:
    """A chunk without its caption, the first line if that is in square brackets."""
    first = F.substring_index(text, "\n", 1)
    caption = text.startswith("[") & F.rtrim(first).endswith("]")
    return F.when(caption, F.when(F.instr(text, "\n") > 0, F.substring(text, F.instr(text, "\n") + 1, F.length(text))).otherwise("")).otherwise(text)


def letters(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\p{L}"))


def foreign_letters(text: Column) -> Column:
    """Letters beyond the Latin blocks (U+024F)."""
    return F.regexp_count(text, F.lit(r"[\p{L}&&[^\u0000-ɏ]]"))


def foreign_share(text: Column) -> Column:
    """The share of foreign letters among all, 0 for a text without letters."""
    return F.coalesce(foreign_letters(text) / F.nullif(letters(text), F.lit(0)), F.when(text.isNotNull(), 0.0))


def _share(found: Column, listed: list[str]) -> Column:
    return F.size(F.filter(found, lambda w: w.isin(listed))) / F.size(found)


def is_spanish(text: Column) -> Column:
    """By the shares of function words."""
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-záéíóúüñ]+"), F.lit(0))
    return F.when(F.size(found) < SPANISH_WORDS, False).otherwise((_share(found, SPANISH) >= SPANISH_SHARE) & (_share(found, ENGLISH) < ENGLISH_SHARE))


def is_foreign(text: Column) -> Column:
    """Mostly of another script, or Spanish."""
    return ((foreign_letters(text) >= FOREIGN_LETTERS) & (foreign_share(text) > FOREIGN_SHARE)) | is_spanish(text)


def content_id(text: Column, hierarchy: Column, index: Column) -> Column:
    """32 hex digits of SHA-256 over the squeezed text, the hierarchy and the index, separated by NUL."""
    zero = F.char(F.lit(0))
    return F.substring(F.sha2(F.concat(squeezed(text), zero, F.array_join(hierarchy, "/"), zero, index.cast("string")), 256), 1, 32)
