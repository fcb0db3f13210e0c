"""Pages of HTML to titles, texts, links, tables and question-answer pairs.

A page becomes a small tree by the standard library's parser; readers of the tree run in batches over Arrow. What a reader finds
is an array of structs, one row per page, so that the relational part goes on with explode() in the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import unquote, urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.operators.chunking import ROWS_LEAST, ROWS_MOST, group

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = frozenset("script style noscript template".split())
FURNITURE = HIDDEN | frozenset("nav footer header aside form".split())
#: An open element of these is closed by the next of the same kind.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "p": {"p"}, "option": {"option"}}
#: Question-like openings besides a closing question mark (fixed values).
OPENERS = ("how ", "what ", "when ", "where ", "who ", "why ", "can i", "do i", "does ", "is ", "are ", "will ", "am i", "should ", "may i", "must i")
#: A page's pairs count from so many, covering so much of its words; a panel below so many words, or with such a share in links, is a menu; rest text counts from so many words.
LEAST_PAIRS, LEAST_COVERED, PANEL_WORDS, LINK_SHARE, REST_WORDS = 2, 0.20, 20, 0.6, 30


class Node:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def all(self, *tags: str) -> list[Node]:
        return [n for n in self.walk() if n.tag in tags and n is not self]

    def first(self, *tags: str) -> Node | None:
        return next((n for n in self.walk() if n.tag in tags and n is not self), None)

    def inside(self, tag: str) -> bool:
        node = self.parent
        while node is not None and node.tag != tag:
            node = node.parent
        return node is not None

    def after(self) -> list[Node]:
        """The elements that follow it under the same parent."""
        if self.parent is None:
            return []
        beside = [c for c in self.parent.children if isinstance(c, Node)]
        return beside[next(i for i, c in enumerate(beside) if c is self) + 1 :]

    def text(self, without: frozenset[str] = HIDDEN) -> str:
        """Its text with single spaces, also where only tags stand between."""
        parts: list[str] = []
        stack: list[Node | str] = [self]
        while stack:
            item = stack.pop()
            if isinstance(item, str):
                parts.append(item)
            elif item.tag not in without:
                stack += reversed(item.children)
        return " ".join(" ".join(parts).split())

    def drop(self) -> None:
        if self.parent is not None:
            self.parent.children = [c for c in self.parent.children if c is not self]
            self.parent = None


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.here = Node("", {}, None)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        shut = CLOSES.get(tag)
        if shut and self.here.tag in shut:
            self.here = self.here.parent or self.root
            if tag == "tr" and self.here.tag == "tr":
                self.here = self.here.parent or self.root
        node = Node(tag, {k: v or "" for k, v in attrs}, self.here)
        self.here.children.append(node)
        if tag not in VOID:
            self.here = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.here.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.here))

    def handle_endtag(self, tag: str) -> None:
        node = self.here
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.here = node.parent

    def handle_data(self, data: str) -> None:
        self.here.children.append(data)


def parse(html: str | None) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


def title(root: Node) -> str | None:
    node = root.first("title")
    return (node.text() or None) if node else None


def main_text(root: Node) -> str:
    """The text of main, else article, else an element with the id content, else body, without furniture."""
    by_id = next((n for n in root.walk() if n.attrs.get("id") == "content"), None)
    node = root.first("main") or root.first("article") or by_id or root.first("body") or root
    return node.text(FURNITURE)


def links(root: Node, base: str | None = None) -> list[dict]:
    """href, text and up to 200 characters around each link; relative ones are resolved against the base, other schemes left out."""
    out = []
    for a in root.all("a"):
        href = a.attrs.get("href", "").strip()
        full = urljoin(base, href) if base else href
        if href and not href.startswith("#") and urlsplit(full).scheme in ("http", "https", ""):
            out.append({"href": full, "text": a.text(), "context": a.parent.text()[:200] if a.parent else ""})
    return out


def breadcrumb(root: Node, url: str | None = None) -> list[str]:
    """The items of an element marked as breadcrumb, else the words of the URL's path."""
    for n in root.walk():
        mark = " ".join((n.attrs.get("class", ""), n.attrs.get("id", ""), n.attrs.get("aria-label", ""))).lower()
        if "breadcrumb" in mark:
            items = [x for x in (c.text() for c in (n.all("li") or n.all("a", "span"))) if x]
            if items:
                return items
    return [unquote(p).replace("-", " ").replace("_", " ").title() for p in urlsplit(url or "").path.split("/") if p]


def decoded_emails(html: str) -> str:
    """Addresses that a proxy hid as hexadecimal digits under a key byte, in the clear; what doesn't decode stays."""

    def clear(m: re.Match) -> str:
        try:
            data = bytes.fromhex(m[1])
            return bytes(b ^ data[0] for b in data[1:]).decode()
        except (ValueError, IndexError):
            return m[0]

    return re.sub(r'<(?:a|span)\b[^>]*data-cfemail="([0-9a-fA-F]*)"[^>]*>.*?</(?:a|span)>', clear, html, flags=re.S)


def table_rows(root: Node) -> list[dict]:
    """Per table its caption, and its rows as `header: value` pairs, or bare values where the numbers of cells differ.

    Headers are the first row of thead, else a first row of th alone. Blank values and rows are left out, as are tables without other rows.
    """
    out = []
    for index, table in enumerate(root.all("table")):
        head = table.first("thead")
        first = (head or table).first("tr")
        cells = [c.text() for c in first.all("th", "td")] if first and head else []
        if not cells and (row := table.first("tr")) and row.all("th") and not row.all("td"):
            first, cells = row, [c.text() for c in row.all("th")]
        body = table.first("tbody") or table
        rows = []
        for tr in body.all("tr"):
            if tr is first and cells or head is not None and tr.inside("thead"):
                continue
            values = [c.text() for c in tr.all("td", "th")]
            if any(values):
                paired = zip(cells, values) if len(cells) == len(values) and cells else (("", v) for v in values)
                rows.append(" | ".join(f"{h}: {v}" if h else v for h, v in paired if v))
        if rows:
            caption = table.first("caption")
            out.append({"table_index": index, "caption": caption.text() if caption else "", "rows": rows})
    return out


def table_chunks(root: Node) -> list[dict]:
    """The rows of each table in groups, under the caption in brackets, with the numbers of their first and last row."""
    out = []
    for t in table_rows(root):
        for a, b in group([len(r) for r in t["rows"]], ROWS_LEAST, ROWS_MOST):
            text = "\n".join(t["rows"][a:b])
            out.append({"text": f"[{t['caption']}]\n{text}" if t["caption"] else text, "table_index": t["table_index"], "row_start": a, "row_end": b - 1})
    return out


def is_question(text: str) -> bool:
    low = text.strip().lower()
    return low.endswith("?") or low.startswith(OPENERS)


Pair = tuple[str, str, str]  # question or label, answer, kind: question, rumor or label


def _lists(root: Node) -> Iterator[tuple[list[Pair], list[Node]]]:
    for dt in (d for dl in root.all("dl") for d in dl.all("dt")):
        run = []
        for n in dt.after():
            if n.tag != "dd":
                break
            run.append(n)
        if run and is_question(dt.text()):
            yield [(dt.text(), " ".join(n.text() for n in run), "question")], [dt, *run]


def _panel(label: str, body: str, node: Node) -> list[Pair]:
    if is_question(label):
        return [(label, body, "question")]
    words = len(body.split())
    if words < PANEL_WORDS or sum(len(a.text().split()) for a in node.all("a")) / words > LINK_SHARE:
        return []
    units = [m for u in re.split(r"(?=\bRumor:)", body) if (m := re.match(r"\s*Rumor:\s*(.+?)\s*\bFact:\s*(.+)$", u, re.S))]
    if len(units) >= 2:
        return [(m[1].strip(), m[2].strip(), f"rumor\0{label}") for m in units]
    return [(label, body, "label")]


def _details(root: Node) -> Iterator[tuple[list[Pair], list[Node]]]:
    for d in root.all("details"):
        summary = d.first("summary")
        if summary is None or d.inside("details"):
            continue
        label = summary.text()
        body = " ".join(c.text() if isinstance(c, Node) else " ".join(c.split()) for c in d.children if c is not summary).strip()
        if label and body:
            yield _panel(label, " ".join(body.split()), d), [d]


def _panels(root: Node) -> Iterator[tuple[list[Pair], list[Node]]]:
    """Headings that open a collapsible element: they name its id, or it follows them or their parent."""
    ids = {n.attrs["id"]: n for n in root.walk() if n.attrs.get("id")}
    for n in root.walk():
        target = n.attrs.get("data-target") or n.attrs.get("data-bs-target") or (n.attrs.get("href", "") if n.attrs.get("data-toggle") or n.attrs.get("data-bs-toggle") else "")
        body = ids.get(target.lstrip("#")) if target.startswith("#") else None
        if body is not None and n.text() and body.text():
            yield _panel(n.text(), body.text(), body), [n, body]


def _headings(root: Node) -> Iterator[tuple[list[Pair], list[Node]]]:
    for h in root.all("h2", "h3", "h4"):
        run = []
        for n in h.after():
            if n.tag in ("h1", "h2", "h3", "h4") and n.tag <= h.tag:
                break
            if n.text():
                run.append(n)
        if run and is_question(h.text()):
            yield [(h.text(), " ".join(n.text() for n in run), "question")], [h, *run]


def _bold(root: Node) -> Iterator[tuple[list[Pair], list[Node]]]:
    """A paragraph whose bold start is a question, answered by its rest or by what follows up to the next such paragraph."""
    opens = [p for p in root.all("p", "div", "li") if (b := p.first("strong", "b")) and is_question(b.text()) and p.text().startswith(b.text())]
    for p in (x for x in opens if not any(x is not y and y.inside(x.tag) and x in _above(y) for y in opens)):
        bold = p.first("strong", "b").text()
        rest, run = p.text()[len(bold) :].strip(), []
        if not rest:
            for n in p.after():
                if n in opens or n.tag in ("h1", "h2", "h3", "h4"):
                    break
                run.append(n)
        answer = " ".join([rest, *(n.text() for n in run)]).strip()
        if answer:
            yield [(bold, answer, "question")], [p, *run]


def _above(node: Node) -> list[Node]:
    out = []
    while node.parent is not None:
        node = node.parent
        out.append(node)
    return out


def _anchors(root: Node) -> Iterator[tuple[list[Pair], list[Node]]]:
    """Questions that link to a place in the page, where an answer of PANEL_WORDS words or more stands."""
    places = {n.attrs.get("id") or n.attrs.get("name"): n for n in root.walk() if n.attrs.get("id") or n.tag == "a" and n.attrs.get("name")}
    for a in root.all("a"):
        target = a.attrs.get("href", "")
        place = places.get(target[1:]) if target.startswith("#") else None
        if place is None or not is_question(a.text()):
            continue
        near = place if place.text() and place.tag != "a" else place.parent
        answer = " ".join([near.text() if near else "", *(n.text() for n in (near.after()[:3] if near else []))]).strip()
        if answer.startswith(a.text()):
            answer = answer[len(a.text()) :].strip()
        if len(answer.split()) >= PANEL_WORDS:
            yield [(a.text(), answer, "question")], []


FINDERS: tuple[Callable, ...] = (_lists, _details, _panels, _headings, _bold, _anchors)


def question_pairs(html: str) -> tuple[list[dict], str]:
    """The pairs of the kind of markup that covers most of the page's words, and the text that they leave.

    Each pair has question, answer, section and the rendered text. A kind counts with LEAST_PAIRS pairs that cover LEAST_COVERED
    of the words; of equal coverage the first kind wins. Rest text under REST_WORDS words, and that of linked places, is dropped.
    """
    whole = max(1, len(parse(html).text().split()))
    best: tuple[float, list[Pair], str] = (0.0, [], "")
    for finder in FINDERS:
        root = parse(html)
        found = list(finder(root))
        pairs = [p for some, _ in found for p in some]
        covered = sum(len(q.split()) + len(a.split()) for q, a, _ in pairs) / whole
        if len(pairs) >= LEAST_PAIRS and covered >= LEAST_COVERED and covered > best[0]:
            for _, nodes in found:
                for n in nodes:
                    n.drop()
            rest = "" if finder is _anchors else root.text()
            best = (covered, pairs, rest if len(rest.split()) >= REST_WORDS else "")
    out = []
    for question, answer, kind in best[1]:
        kind, _, section = kind.partition("\0")
        q, a = ("Rumor: ", "Fact: ") if kind == "rumor" else ("", "") if kind == "label" else ("Q: ", "A: ")
        out.append({"question": question, "answer": answer, "section": section, "text": (f"[{section}]\n" if section else "") + f"{q}{question}\n{a}{answer}"})
    return out, best[2]


def structure(root: Node) -> str | None:
    """`faq` or `table_data`, where the markup says so."""
    marked = [n for n in root.walk() if re.search(r"accordion|collapsible|faq-item|toggle", n.attrs.get("class", ""), re.I)]
    asked = [n for n in root.all("h2", "h3", "h4", "strong") if n.text().endswith("?")]
    if any(len(dl.all("dt")) >= 3 for dl in root.all("dl")) or max(len(root.all("details")), len(marked), len(asked)) >= 3:
        return "faq"
    return "table_data" if sum(len(t.all("tr")) for t in root.all("table")) >= 5 else None


_LINK = "array<struct<href:string,text:string,context:string>>"
_ROWS = "array<struct<text:string,table_index:int,row_start:int,row_end:int>>"
_PAIRS = "array<struct<question:string,answer:string,section:string,text:string>>"


def read_pages(pages: DataFrame, key: str = "url", html: str = "html") -> DataFrame:
    """(key, title, text, breadcrumb, structure, links, tables, pairs, rest) of each page; null HTML gives nulls and empty arrays."""
    kind = pages.schema[key].dataType.simpleString()
    names = [key, "title", "text", "breadcrumb", "structure", "links", "tables", "pairs", "rest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                source = decoded_emails(source) if source and "data-cfemail" in source else source
                root, base = parse(source), str(k) if k is not None and "://" in str(k) else None
                pairs, rest = question_pairs(source) if source else ([], "")
                rows.append((title(root), main_text(root) if source is not None else None, breadcrumb(root, base), structure(root), links(root, base), table_chunks(root), pairs, rest))
            columns = list(zip(*rows)) if rows else [()] * 8
            struct = lambda **f: pa.list_(pa.struct(list(f.items())))
            types = [pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), struct(href=pa.string(), text=pa.string(), context=pa.string()),
                     struct(text=pa.string(), table_index=pa.int32(), row_start=pa.int32(), row_end=pa.int32()), struct(question=pa.string(), answer=pa.string(), section=pa.string(), text=pa.string()), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), t) for c, t in zip(columns, types))], names)

    return pages.select(key, html).mapInArrow(run, f"`{key}` {kind}, title string, text string, breadcrumb array<string>, structure string, links {_LINK}, tables {_ROWS}, pairs {_PAIRS}, rest string")
