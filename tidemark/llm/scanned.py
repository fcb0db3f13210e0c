"""Repair of text from scanned pages.

A lexicon (words with counts over the whole corpus, at most LEXICON of them) is counted first. Each chunk is then read without its
page furniture as one stream of tokens with the line ends taken out, over which a lattice is decoded. Its arcs are a token as
printed, a token with confusions undone, a word broken at a line's end with or without a hyphen, a word with a space within, and two
words run together; an arc costs what its words cost by their frequency, and what its kind of defect costs. The cheapest path is the
reading: words broken over a line and misread words are found where it takes those arcs, and the repaired text is what it says.
Tokens that have no arc but themselves divide the stream, and only the stretches between them are decoded. Paragraph boundaries between
lines are chosen by dynamic programming over line lengths, ends of sentences and blank lines.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import outline

#: Words in the lexicon at most, the most frequent ones; and the count from which a word is one.
LEXICON, LEAST_COUNT = 200_000, 5
#: A known word may stand for a rarer one by confusion if it is so many times as frequent.
RATIO = 8
#: Misrecognised strings and what was printed (what recognition commonly confuses).
CONFUSIONS: list[tuple[str, str]] = [
    ("0", "o"), ("1", "l"), ("1", "i"), ("1", "t"), ("5", "s"), ("6", "b"), ("6", "g"), ("9", "g"), ("9", "q"), ("8", "b"), ("3", "e"), ("4", "a"), ("7", "t"), ("2", "z"), ("@", "a"), ("!", "i"), ("!", "l"), ("$", "s"), ("|", "l"), ("|", "i"), ("€", "e"), ("£", "e"),
    ("rn", "m"), ("m", "rn"), ("cl", "d"), ("d", "cl"), ("vv", "w"), ("ii", "u"), ("li", "h"), ("h", "li"), ("m", "in"), ("in", "m"), ("m", "ni"), ("rm", "nn"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl"),
    ("c", "e"), ("c", "o"), ("c", "s"), ("c", "i"), ("c", "l"), ("f", "t"), ("b", "h"), ("i", "l"), ("l", "i"), ("ſ", "s"),
]
#: A misread string of two signs must stand for a word that makes up this part of the text at least.
SHORT = 1000
#: Signs at a line's end that break a word.
HYPHENS = "-‐‑¬­"
#: What a kind of arc costs beside its words: confusions undone, a word taken for broken without a hyphen, with a space within, or run together.
MISREAD, BARE, SPACED, RUN = math.log(RATIO), 2.0, 4.0, 6.0
#: What it costs to leave a word unbroken before a sign that is no plain hyphen.
SIGNED = 30.0
_words = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*").findall
_number = re.compile(
    r"\s*(?:\[\s*\d{1,4}\s*\]|\(\s*\d{1,4}\s*\)|[-–—~*•]\s*\d{1,4}\s*[-–—~*•]|(?:page|pg\.?|p\.|seite|página|pag\.)\s*\d{1,4}(?:\s*(?:of|/|von|de)\s*\d{1,4})?|\d{1,4}\s*(?:of|/)\s*\d{1,4}|\d{1,4}|[ivxlc]{1,7})\s*", re.I
)
_numbered = re.compile(r"\s*(?:\d{1,4}\s*\|\s*(?P<a>\S.*)|(?P<b>\S.*?)\s*(?:\|\s*|\s{2,})(?:page\s*)?\d{1,4})\s*", re.I)
_verbs = re.compile(r"\b(?:is|are|was|were|will|may|must|said|had|has|have|can|cannot|should|runs|who|that|showed|asked|reported|explained|pays|moved|takes|counted|held|because|unless|if|kept|did|does|do|been|be|covers)\b", re.I)
#: Words and openings by which a line is part of a sentence rather than a title.
_told = re.compile(r"\b(?!detailed\b|unannounced\b|limited\b)[a-z]{2,}ed\b|\b(?:allows|leads|decides|opens|closes|keeps|makes|needs|store|ask|bring|submit)\b")
_opening = re.compile(r"(?:to|in|if|when|during|please|according|even|as|before|after|once|while|unless|provided|no|every|early voting|parking|training for|results for|candidates|an?|could|i|we|he|she|they|it|this|that|there|january|february|march|april|may|june|july|august|september|october|november|december|street|road|lane|drive|avenue|court|pike) ", re.I)
_name = re.compile(r"[A-Z0-9][\w'’.-]*")
_broken = re.compile(rf"([^\W\d_]+)[{HYPHENS}]$")
_begin = re.compile(r"\s*([^\W\d_]+)")
_stop = re.compile(r"[.!?:;]['\")\]”]*\s*$")
_core = re.compile(r"^[\s\"'“”‘’(\[{<.,;:?–—-]+|[\s\"'“”‘’)\]}>.,;:?!–—-]+$")
_split = re.compile(r"[-'’.,/]")
_letters = re.compile(r"[^\W\d_]")
_alien = re.compile(r"[^a-zà-öø-ÿ'’-]")


def broken(line: str) -> re.Match | None:
    """The last word of a line that ends with a hyphen."""
    end = line.rstrip()
    return _broken.search(end.rsplit(None, 1)[-1]) if end and end[-1] in HYPHENS else None


def heading(line: str) -> bool:
    """Reads like a title: starts with a capital or number, has no verb of a sentence and doesn't end one."""
    text = line.strip()
    words = text.split()
    if not 2 <= len(words) <= 16:
        return False
    low = text.lower()
    if text[0] == "[" or text[-1] == "]" or " through " in low and ", and " in low or _told.search(low) or _opening.match(low) or low.startswith("the ") and " and the " not in low:
        return False
    return bool(_name.match(text)) and not _stop.search(text) and not _verbs.search(text) and (text.isupper() or text[0].isupper()) and not text.endswith((",", "-", "of", "the", "and", "a"))


def furniture(lines: list[str], title: str | None = None) -> list[bool]:
    """Which lines are page numbers and running headers.

    A running header reads like a title and stands by a page number, has one in its line, or comes again in the same text and in the
    middle of a sentence.
    """
    n = len(lines)
    out = [bool(_number.fullmatch(x)) and any(c.isalnum() for c in x) for x in lines]
    if sum(out) > max(4, 0.3 * n):  # a column of numbers
        out = [False] * n
    for i, x in enumerate(lines):
        text = x.strip()
        if not out[i] and text and (text[0].isdigit() and "|" in text[:12] or text[-1].isdigit()) and "..." not in x and (m := _numbered.fullmatch(text)):
            part = m["a"] or m["b"]
            if part and "|" not in part and "  " not in part and (heading(part) or m["a"] and part[:1].isupper() and not _verbs.search(part)):
                out[i] = True
    if sum(out) > max(4, 0.3 * n):
        return [False] * n
    count = Counter(" ".join(x.lower().split()) for x in lines if x.strip())
    own = " ".join(title.lower().split()) if title else None
    numbers = [i for i, f in enumerate(out) if f]
    for i, x in enumerate(lines):
        if out[i] or not x.strip() or not heading(x):
            continue
        low = " ".join(x.lower().split())
        by = i - 1 in numbers or i + 1 in numbers
        before, after = _around(lines, out, i)
        cut_off, goes_on = bool(before) and not _stop.search(before), after[:1].islower()
        if by and (low != own or count[low] > 1) or low != own and count[low] > 1 and (cut_off or goes_on):
            out[i] = True
    return out


def _around(lines: list[str], marks: list[bool], i: int) -> tuple[str, str]:
    """The lines of the body before and after."""
    before = next((lines[k].strip() for k in range(i - 1, -1, -1) if lines[k].strip() and not marks[k]), "")
    after = next((lines[k].strip() for k in range(i + 1, len(lines)) if lines[k].strip() and not marks[k]), "")
    return before, after


class Decoder:
    """Decodes against a lexicon of word counts."""

    def __init__(self, lexicon: dict[str, int]) -> None:
        self.lexicon = lexicon
        self.total = sum(lexicon.values()) + 1
        self.known: dict[str, str | None] = {}
        self.looks: dict[str, tuple[str, float, str | None, bool]] = {}

    def cost(self, word: str) -> float:
        """Cheap for frequent words; strings that are none cost by length."""
        n = self.lexicon.get(word)
        return math.log(self.total / n) if n else math.log(self.total) + 2.0 * len(word)

    def undone(self, word: str) -> str | None:
        """The word that was printed, if `word` (lower case) is one with misrecognised characters."""
        if word not in self.known:
            if len(self.known) > 300_000:
                self.known.clear()
            self.known[word] = self._undo(word)
        return self.known[word]

    def _undo(self, word: str) -> str | None:
        have = self.lexicon.get(word, 0)
        alien = [i for i, c in enumerate(word) if _alien.match(c)]
        if len(word) < (2 if alien else 3) or len(word) > 40 or len(alien) > 0.6 * len(word):
            return None
        best, count = None, max(LEAST_COUNT, RATIO * have) - 1
        for seen, printed in CONFUSIONS:
            k = word.find(seen)
            if k < 0:
                continue
            tries = [word.replace(seen, printed)]
            while k >= 0:
                tries.append(word[:k] + printed + word[k + len(seen) :])
                k = word.find(seen, k + 1)
            for t in tries:
                if self.lexicon.get(t, 0) > count:
                    best, count = t, self.lexicon[t]
        if best is None and 1 <= len(alien) <= 3 and len(word) >= 4:
            # any letter may be behind a sign that no word has; a second one by confusion
            for i in alien[:1] if len(alien) == 1 else ():
                for c in "abcdefghijklmnopqrstuvwxyz":
                    t = word[:i] + c + word[i + 1 :]
                    if self.lexicon.get(t, 0) > count:
                        best, count = t, self.lexicon[t]
            if best is None:
                t = word
                for seen, printed in CONFUSIONS:
                    if len(seen) == 1 and _alien.match(seen):
                        t = t.replace(seen, printed)
                if self.lexicon.get(t, 0) > count:
                    best = t
        return best

    def misread(self, token: str) -> str | None:
        """The printed form of a token of the text, if it has misrecognised characters."""
        core = _core.sub("", token.rstrip("!"))
        low = core.lower()
        if not _letters.search(low):
            return None
        for part in low.split("-") if "-" in low else (low,):
            part = part[:-2] if part.endswith(("'s", "’s")) else part
            # undone() has weighed the counts against each other; a bound on the count alone would depend on the corpus' size
            if part and _letters.search(part) and (printed := self.undone(part)) is not None and (len(part) > 2 or self.lexicon[printed] * SHORT >= self.total):
                return printed
        return None

    def reads(self, tokens: list[str]) -> bool:
        """Whether a line is text: half of its tokens with letters are words, as printed."""
        words = [c for t in tokens if (c := _core.sub("", t).lower()) and _letters.search(c)]
        good = sum(all(p in self.lexicon or not _letters.search(p) for p in _split.split(w)) for w in words)
        return 2 * good >= len(words)

    def parts(self, word: str) -> tuple[str, str] | None:
        """The cheapest two known words that an unknown one may be, run together."""
        if word in self.lexicon or len(word) < 5 or not word.isalpha():
            return None
        best, found = math.inf, None
        for i in range(2, len(word) - 1):
            a, b = word[:i], word[i:]
            if a in self.lexicon and b in self.lexicon and (c := self.cost(a) + self.cost(b)) < best:
                best, found = c, (a, b)
        return found

    def look(self, token: str) -> tuple[str, float, str | None, bool]:
        """(core, its cost, what was printed if it may be misread, whether it has no arc but itself)."""
        seen = self.looks.get(token)
        if seen is None:
            if len(self.looks) > 300_000:
                self.looks.clear()
            core = _core.sub("", token).lower()
            bare = core[:-2] if core.endswith(("'s", "’s")) else core
            printed = self.misread(token)
            known = not _letters.search(core) or all(p in self.lexicon or not _letters.search(p) for p in _split.split(bare))
            cost = self.cost(bare) if bare in self.lexicon or not known else 0.0
            seen = self.looks[token] = (bare, cost, printed, known and printed is None)
        return seen

    def over_line(self, left: str, right: str, upper: bool) -> float | None:
        """What it costs to read a line's last and the next line's first token as one word; None where no word can be broken."""
        if m := broken(left):
            b = _begin.match(right)
            if not b or not (b[1][:1].islower() or upper or left[-1] != "-"):
                return None
            whole = (m[1] + b[1]).lower()
            cost = self.cost(whole)
            if whole not in self.lexicon and (printed := self.undone(whole)):
                cost = min(cost, self.cost(printed) + MISREAD)
            return cost
        a, c = left.lower(), _core.sub("", right).lower()
        if not a.isalpha() or not c.isalpha() or not right[:1].islower() or a in self.lexicon and c in self.lexicon or a + c not in self.lexicon:
            return None
        return self.cost(a + c) + BARE

    def decode(self, lines: list[list[str]]) -> list[tuple[int, int, str]]:
        """The cheapest path over the tokens of lines: (first token, tokens, kind) of each arc other than a token as printed.

        Tokens are numbered through all lines. Kinds are misread, hyphen and bare (one word over a line's end), spaced and run.
        """
        tokens = [t for line in lines for t in line]
        ends, k = {}, 0  # the last token of each line -> whether the line is in capitals
        for line in lines:
            k += len(line)
            if line:
                ends[k - 1] = " ".join(line).isupper()
        looks = [self.look(t) for t in tokens]
        n, out = len(tokens), []
        unsettled = [i for i, x in enumerate(looks) if not x[3]]
        unsettled += [i for i in ends if tokens[i][-1] in HYPHENS]
        at = 0
        for i in sorted(set(unsettled)):
            start = max(at, i - 1)
            if start >= n or i + 1 < at:
                continue
            stop = i + 1
            while stop < n and (not looks[stop][3] or not looks[stop - 1][3] or stop in ends and tokens[stop][-1] in HYPHENS or stop - 1 in ends and tokens[stop - 1][-1] in HYPHENS):
                stop += 1
            out += self._stretch(tokens, looks, ends, start, stop)
            at = stop
        return out

    def _stretch(self, tokens: list[str], looks: list, ends: dict[int, bool], start: int, stop: int) -> list[tuple[int, int, str]]:
        best = [math.inf] * (stop - start + 1)
        back: list[tuple[int, str]] = [(0, "")] * (stop - start + 1)
        best[0] = 0.0
        for i in range(start, stop):
            here, at = best[i - start], i - start
            core, cost, printed, settled = looks[i]
            arcs = [(1, cost, "")]
            if i in ends and (m := broken(tokens[i])):
                arcs = [(1, self.cost(m[1].lower()), "")]
                if i + 1 < stop and (found := self.over_line(tokens[i], tokens[i + 1], ends[i])):
                    arcs = [(1, arcs[0][1] + (SIGNED if tokens[i][-1] != "-" else 0.0), ""), (2, found, "hyphen")]
            elif printed is not None:
                arcs.append((1, min(cost, self.cost(printed) + MISREAD) - 1e-9, "misread"))
            elif not settled and (two := self.parts(core)):
                arcs.append((1, self.cost(two[0]) + self.cost(two[1]) + RUN, "run"))
            if i + 1 < stop and not (i in ends and tokens[i][-1] in HYPHENS):
                whole = core + looks[i + 1][0]
                if i in ends:
                    if (found := self.over_line(tokens[i], tokens[i + 1], ends[i])) is not None:
                        arcs.append((2, found, "bare"))
                elif tokens[i].isalpha() and not (settled and looks[i + 1][3]) and tokens[i + 1][:1].islower() and whole.isalpha() and whole in self.lexicon:
                    arcs.append((2, self.cost(whole) + SPACED, "spaced"))
            for length, c, kind in arcs:
                if here + c < best[at + length]:
                    best[at + length], back[at + length] = here + c, (length, kind)
        path, at = [], stop - start
        while at > 0:
            length, kind = back[at]
            if kind:
                path.append((start + at - length, length, kind))
            at -= length
        return path[::-1]


def defects(text: str, title: str | None, decoder: Decoder) -> list[tuple[int, str]]:
    """(line_no, defect) of a chunk: furniture by the layout, split and misread lines by the reading of the body."""
    lines = text.split("\n")
    marks = furniture(lines, title)
    out = [(i, "furniture") for i, m in enumerate(marks) if m]
    body = [i for i, x in enumerate(lines) if not marks[i] and x.strip()]
    tokens = [lines[i].split() for i in body]
    line_of = [k for k, line in enumerate(tokens) for _ in line]
    seen = set()
    for at, _, kind in decoder.decode(tokens):
        k = line_of[at]
        if kind in ("hyphen", "bare"):
            seen.add((body[k], "split"))
        elif kind == "misread" and (body[k], "misread") not in seen and decoder.reads(tokens[k]):
            seen.add((body[k], "misread"))
    return out + sorted(seen)


def repaired(text: str, title: str | None, decoder: Decoder) -> str:
    """The text without furniture, broken words joined, misread characters undone, in paragraphs separated by a blank line."""
    lines = text.split("\n")
    marks = furniture(lines, title)
    body: list[tuple[str, bool]] = []  # text, blank line before
    blank = False
    for x, m in zip(lines, marks):
        if m:
            continue
        if not x.strip():
            blank = True
            continue
        body.append((x.strip(), blank))
        blank = False
    if not body:
        return ""
    width = max(len(x) for x, _ in body)
    # least[j]: the least cost of dividing the lines up to j. A gap's costs are what speaks against a break and against going on,
    # and don't depend on how long the paragraph is, so that one step back is enough at any number of lines
    least, starts = 0.0, [0]
    for j, ((a, _), (b, gap)) in enumerate(zip(body, body[1:]), 1):
        ends, goes_on = bool(_stop.search(a)), b[:1].islower() or a[-1] in HYPHENS
        full = len(a) + len(b.split()[0]) + 1 > width * 0.9
        cost_break = 4.0 * goes_on + 2.0 * (not ends) + 1.5 * full + (0 if gap else 1.0) - 3.0 * (len(a.split()) <= 2 and heading(a))
        cost_join = 3.0 * gap + 1.5 * (ends and not full) + 2.0 * heading(a)
        least += min(cost_break, cost_join)
        if cost_break < cost_join:
            starts.append(j)
    starts = set(starts)
    tokens = [x.split() for x, _ in body]
    arcs = {at: (length, kind) for at, length, kind in decoder.decode(tokens)}
    paragraphs: list[list[str]] = []
    flat = [(t, k, p == 0) for k, line in enumerate(tokens) for p, t in enumerate(line)]
    i = 0
    while i < len(flat):
        token, k, opens = flat[i]
        if opens and k in starts:
            paragraphs.append([])
        length, kind = arcs.get(i, (1, ""))
        if length == 2 and i + 1 < len(flat) and flat[i + 1][2] and flat[i + 1][1] in starts:
            length, kind = 1, ""  # no word goes on over a paragraph's end
        if kind == "hyphen":
            whole = token[:-1] + flat[i + 1][0]
            token = _restored(whole, decoder)
        elif length == 2:
            token += flat[i + 1][0]
        elif kind == "misread":
            token = _restored(token, decoder)
        elif kind == "run":
            core = _core.sub("", token)
            first, _ = decoder.parts(core.lower())
            token = token.replace(core, core[: len(first)] + " " + core[len(first) :], 1)
        paragraphs[-1].append(token)
        i += length
    return "\n\n".join(map(" ".join, paragraphs))


def _restored(token: str, decoder: Decoder) -> str:
    core = _core.sub("", token.rstrip("!"))
    if not core or (printed := decoder.misread(token)) is None:
        return token
    low = core.lower()
    for part in low.split("-"):
        part = part[:-2] if part.endswith(("'s", "’s")) else part
        if decoder.undone(part) == printed:
            low = low.replace(part, printed, 1)
            break
    return token.replace(core, low.upper() if core.isupper() and len(core) > 1 else low.capitalize() if core[:1].isupper() else low, 1)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) -> (word, n), added up per task as far as memory goes."""
    total: Counter[str] = Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            total.update(_words(text.lower()))
        if len(total) > 500_000:
            yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array(list(total.values()), pa.int64())], ["word", "n"])
            total.clear()
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])


def lexicon(texts: DataFrame, text: str = "text") -> dict[str, int]:
    """The LEXICON most frequent words of the corpus with their counts, of those with LEAST_COUNT or more; ties by the word."""
    counted = texts.filter(F.col(text).isNotNull()).select(text).mapInArrow(_counts, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    top = counted.filter(F.col("n") >= LEAST_COUNT).filter(F.length("word") <= 40).orderBy(F.desc("n"), "word").limit(LEXICON)
    table = top.toArrow()
    return dict(zip(table["word"].to_pylist(), table["n"].to_pylist()))


def _scanned(chunks: DataFrame) -> DataFrame:
    """(chunk_id, text, title) of the chunks of documents that may be scans: not of a type that has its own text."""
    url = F.lower(F.coalesce("source_url", F.lit("")))
    own = F.regexp_extract(url, r"\.([a-z]{3,4})(?:[?#].*)?$", 1).isin("docx", "doc", "csv", "xlsx", "xls", "txt", "html", "htm")
    there = (F.col("page_classification") == "document") & F.col("chunk_id").isNotNull() & F.col("text").isNotNull() & ~own
    return chunks.filter(there).select("chunk_id", "text", "title")


def _with_decoder(rows: DataFrame, words: dict[str, int], work, schema: str) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for batch in batches:
            yield work(batch, decoder)

    return rows.mapInArrow(run, schema)


def find_defects(chunks: DataFrame) -> DataFrame:
    """(chunk_id, line_no, defect) of the chunks of scanned pages: furniture, split and misread lines.

    Which pages are scanned follows from the text alone: chunks of documents whose text wasn't recognised have no such defects.
    needs_ocr is stale and not used. Null and empty texts have no rows, an id delivered twice gives its rows once, an empty table
    none; other columns don't matter.
    """

    def work(batch: pa.RecordBatch, decoder: Decoder) -> pa.RecordBatch:
        out: tuple[list, list, list] = ([], [], [])
        for i, text, title in zip(*(batch.column(k).to_pylist() for k in range(3))):
            for line, defect in defects(text, title, decoder):
                out[0].append(i)
                out[1].append(line)
                out[2].append(defect)
        return pa.RecordBatch.from_arrays([pa.array(out[0], batch.schema.field(0).type), pa.array(out[1], pa.int32()), pa.array(out[2], pa.string())], ["chunk_id", "line_no", "defect"])

    rows = _scanned(chunks)
    kind = rows.schema["chunk_id"].dataType.simpleString()
    return _with_decoder(rows, lexicon(chunks), work, f"chunk_id {kind}, line_no int, defect string").distinct()


def repair(chunks: DataFrame) -> DataFrame:
    """(chunk_id, text): each chunk of a scanned page once, as continuous paragraphs; nulls and repeats as in find_defects()."""

    def work(batch: pa.RecordBatch, decoder: Decoder) -> pa.RecordBatch:
        texts = [repaired(t, ti, decoder) for t, ti in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["chunk_id", "text"])

    rows = _scanned(chunks).dropDuplicates(["chunk_id"])
    kind = rows.schema["chunk_id"].dataType.simpleString()
    return _with_decoder(rows, lexicon(chunks), work, f"chunk_id {kind}, text string")
