"""What kind of thing each line of a page's text is.

Pages arrive as plain lines, so the tag path of a line is rebuilt from its layout: the list marker or separator it carries, the
block of like lines it stands in, its place before, in or after the body, and as its class attribute what it announces (a cookie
notice, a byline, a related box ...). Where a text still has tags, they are part of the path.
"""

from __future__ import annotations

import re
from functools import lru_cache

BLANK, PROSE, HEADING, ITEM, ROW, JUNK, LABEL = range(7)
#: Kinds from here on are no main content.
MENU, CRUMB, SKIP, COOKIE, BOX, BOX_ITEM, PROMPT, BYLINE, LEGAL, OFFICE, DATE, TAGS, TURN = range(20, 33)
NAMES = {
    BLANK: "blank", PROSE: "p", HEADING: "h", ITEM: "li", ROW: "tr", JUNK: "junk", LABEL: "label", MENU: "nav.menu", CRUMB: "nav.crumb", SKIP: "a.skip", COOKIE: "div.cookie",
    BOX: "aside.head", BOX_ITEM: "aside.item", PROMPT: "div.prompt", BYLINE: "p.byline", LEGAL: "footer.legal", OFFICE: "footer.office", DATE: "footer.date", TAGS: "footer.tags", TURN: "nav.turn",
}

_spaces = re.compile(r"\s+")
#: Decoration around a line: list markers before it, and arrows, bars and dots after it.
_lead = re.compile(r"^(?:[•◦▪‣·*>–—|-]|»|›|▸|►|\d{1,3}[.)])\s+")
_tail = re.compile(r"\s*(?:[|»›▸►→]|\.\.\.|…)$")

_MONTH = r"(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
_DATE = rf"(?:{_MONTH} \d{{1,2}}(?:,? \d{{4}})?|\d{{1,2}} {_MONTH}(?: \d{{4}})?|\d{{4}}-\d\d-\d\d|\d{{1,2}}[/.]\d{{1,2}}[/.]\d{{2,4}})"
_ORG = r"(?:the )?(?:[\w' -]{0,40})(?:board|office|registrar|department|division|bureau|commission|county|city|town|state|agency|clerk)\b[\w' ,.&-]*"

#: What a line announces, by its lower-cased text without decoration; the first that matches counts.
CUES: list[tuple[int, str]] = [
    (SKIP, r"(?:skip|jump) (?:directly )?to (?:the )?(?:main )?(?:content|navigation|menu|page)|back to (?:the )?top|zum inhalt springen|saltar al contenido"),
    (COOKIE, r"(?:we|this (?:web)?site|this portal|our (?:web)?(?:site|pages)) uses? cookies\b.*|cookie (?:settings|preferences|policy|consent|notice)\b.*"
             r"|your privacy (?:matters|is important)\b.*|this (?:web)?site stores (?:small )?(?:files|data|information) on your (?:device|computer|browser).*"
             r"|utilizamos (?:las )?cookies\b.*|(?:este|nuestro) sitio (?:web )?(?:utiliza|usa) cookies\b.*|by (?:continuing to use|using) this (?:web)?site\b.*|accept (?:all )?cookies|manage (?:cookie )?preferences"),
    (BOX, r"in this section|see also|related (?:pages|links|content|articles|topics|information|documents|reading)|most (?:read|viewed|popular|requested)|you (?:may|might) also (?:like|be interested in)|upcoming(?: events)?"
          r"|popular(?: pages| topics| now)?|try (?:instead|these|one of these)|more (?:from|in|on) (?:this|the)\b.{0,40}|read (?:next|more|also)|quick links|on this page|trending(?: now)?|recommended(?: for you| pages)?|latest news|what'?s new|elsewhere on this site|other pages|featured(?: pages)?"),
    (PROMPT, r"(?:share|print|e-?mail|forward|bookmark|download) (?:this )?page\b.{0,60}|share (?:this|on|via)\b.{0,60}|tell a (?:neighbor|friend)\b.*|(?:was|is) this page (?:helpful|useful)\b.*|did you find (?:this|what)\b.*|rate this page.*"
             r"|subscribe (?:to|for)\b.*|sign up (?:for|to)\b.*(?:alert|update|newsletter|bulletin|email|e-mail|text)\w*\b.*|follow (?:us|the .{3,80}?) (?:on|for|at)\b.*|get (?:email|text) (?:alerts|updates)\b.*|join our (?:mailing list|newsletter).*"
             r"|report (?:an? )?(?:accessibility )?(?:problem|issue|error) (?:with|on) this (?:page|site).*|(?:give|send|leave) (?:us )?(?:your )?feedback\b.*|translate this page\b.*|select (?:a )?language\b.*|la junta de .{2,60} ofrece ayuda gratuita en su idioma"
             r"|reading time:? ?\d+ min\w*|\d+ min(?:ute)?s? read|print(?:er)?[ -]friendly(?: version)?\b.{0,60}|you are visitor (?:number|no\.?)\b.*|listen to this page.*|view (?:as|in) (?:pdf|web page).*|like us on\b.*"),
    (BYLINE, r"by the (?:communications|press|public|media|web|news|editorial|outreach)\b.{0,120}|staff contribution from\b.*|(?:posted|published|written|submitted|prepared|compiled|filed) (?:under|by|in|on)\b.{0,100}|(?:contributed|reporting|edited) by\b.{0,80}|content owner\b(?! review).{0,60}"),
    (LEGAL, r"(?:copyright|©|\(c\)) ?(?:©|\(c\))? ?\d{4}\b.*|.*\ball rights reserved\b.{0,3}|reuse of this material\b.*|prices, times and places may change\b.*|.{0,80}\bis an equal opportunity employer\b.*|this information is provided by\b.*"
            r"|published by (?:the )?authority of\b.*|.{0,80}accepts no liability\b.*|(?:terms (?:of use|and conditions|of service)|privacy (?:policy|notice|statement)|disclaimer|legal notices?|accessibility statement)|.{0,60}not (?:constitute )?legal advice.{0,3}|printed copies are uncontrolled.*|powered by\b.{0,60}"),
    (OFFICE, r".{0,80}\boffice, .{3,120}\|.*|call \(?[\d-]{3,}.{0,20}\bor visit\b.*|.{3,120}\| ?(?:tel|phone|fax|tty)\b.*|(?:tel|phone|fax|tty)[.:]? ?\(?[\d-]{3}.*|(?:mailing|office|street) address:.*|office hours:.*|contact us (?:at|by|on)\b.{0,100}"),
    (DATE, rf"(?:(?:page|site|content|information) )?(?:last )?(?:updated|revised|modified|reviewed|changed|edited)(?: on| at|:)? ?{_DATE}.{{0,12}}|content owner review due\b.*|(?:next )?review(?:ed)? (?:due|date|by):? ?{_DATE}.{{0,12}}|(?:date )?(?:posted|published|last updated):? ?{_DATE}.{{0,12}}"),
    (TAGS, r"(?:tags?|topics?|keywords?|categor(?:y|ies)|filed under|labels?|etiquetas)(?::| -) ?.{1,200}"),
    (TURN, r"(?:previous|next|prev|older|newer|anterior|siguiente)(?: (?:page|post|article|story|entry))?(?::| -)?(?: ?[→←<>»«]| .{1,160})?|« .{1,120}|.{1,120} »"),
]
_cue = re.compile("|".join(f"(?P<k{kind}>{pattern})" for kind, pattern in CUES))
#: First words of the cues, and what the cues that start freely contain; other lines are no cue, which saves the trial.
FIRST = frozenset(
    """skip jump back zum saltar we this our your cookie utilizamos este nuestro by accept manage in see related most you upcoming popular try more read quick on trending recommended latest what's whats elsewhere other featured share print printer
    printer-friendly e-mail email forward bookmark download tell was is did rate subscribe sign follow get join report give send leave translate select la reading listen view like staff posted published written submitted prepared compiled filed contributed reporting edited
    content copyright © (c) reuse prices, terms privacy disclaimer legal accessibility powered call tel tel: tel. phone phone: fax fax: tty tty: mailing office street contact page site information last updated revised modified reviewed changed next review date tag tags tags: topic topics
    topics: keyword keywords keywords: category categories category: categories: filed label labels labels: etiquetas etiquetas: previous previous: next: prev prev: older newer anterior siguiente « upcoming: print: updated: posted: published:""".split()
)
_free = re.compile(r"all rights reserved|equal opportunity employer|accepts no liability|legal advice|printed copies are uncontrolled|office, .*\||\| ?(?:tel|phone|fax|tty)\b| »$|^\d+ min\w* read").search
_bars = re.compile(r"[|»›→/>]|::").search
#: Entries that a box without list markers has at most; what follows is a heading of the page.
BOX_PLAIN = 4


#: What the cues start with, lower-cased; tells a cut line at the end of a shortened text.
STARTS = (
    "skip to content", "we use cookies and", "your privacy matters", "cookie settings", "this site stores small files", "utilizamos cookies para", "translate this page", "reading time:", "subscribe to our", "sign up for text",
    "follow the ", "report an accessibility", "was this page helpful", "tell a neighbor", "share this page", "staff contribution from", "filed under", "by the communications desk", "copyright 20", "reuse of this material",
    "prices, times and places", "this information is provided by", "published by authority", "last updated", "page revised", "content owner review", "previous: ", "you are visitor", "print friendly version", "la junta de ", "in this section", "related pages",
    "see also", "you may also like", "most read", "tags: ",
)
#: Labels that menus of such sites carry.
LABELS = frozenset(
    """home|voting|voter registration|vote by mail|ballot drop boxes|candidates and filing|public meetings|accessibility services|site map|careers|frequently asked questions|board members|rumor control|military and overseas|about the board
    |laws and regulations|maps and data|election results|become an election judge|polling place lookup|press room|early voting|contact us|forms library|campaign finance portal|language help|about us|about|contact|news|calendar|events|search|menu|login|log in
    |sign in|services|departments|government|residents|faq|faqs|help|resources|forms|documents|meetings|elections|results|register to vote|feedback|sitemap|privacy policy|terms of use|accessibility|español|english|newsroom|publications|employment|online services|agencies""".replace("\n", "").replace("    ", "").split("|")
)
_VERB = r"(?:check|request|find|track|download|view|renew|report|print|change|search|look up|update|get|order|submit|pay|apply for|register|locate|see|access)"
_OBJECT = r"(?:past returns|your mail ballot|registration counts|an? watcher pass|your polling place|meeting minutes|an address|your address|precinct maps|judge training dates|sample ballots|your registration|forms|results|records|your status|(?:your |an? |the )?[a-z]+(?: [a-z]+)?)"
_action = re.compile(rf"{_VERB} {_OBJECT}$")
#: Titles as related boxes list them: capitalised, without a full stop, and of one of the shapes that pages are named in.
_title = re.compile(
    r"(?:questions about .+|how .+ (?:vote|register|apply|file)\b.+|.+ results, .+|.+ county: .+|the .+ and the .+|.+ (?:report|hearing|recount|count|notice|calendar|inventory|demonstration|comparison|procedure|inspection|survey|drill|review|briefing|training session|meeting|session|audit|workshop)s? (?:of|for|on|in|at) .+|.+ (?:at|in) [a-z' -]+)"
)
_crumb = re.compile(r"\s*(?:»|›|→|::)\s*|\s+[|/>]\s+")
_csv = re.compile(r'^\s*"[^"]*"(?:\s*[,;]\s*"[^"]*")+\s*$')
_pair = re.compile(r"^[^|:]{1,30}: [^|]+(?:\| ?[^|:]{1,30}: [^|]+)+$")
_columns = re.compile(r"\S(?:\t| {3,})\S")
_dots = re.compile(r"\.{4,}\s*\d+$")
_word = re.compile(r"[^\W\d_]+")
_stop = re.compile(r"[.!?;:。！？…]['\")\]]*$")
_letters = re.compile(r"[^\W\d_]")
_odd = re.compile(r"[^\w\s.,;:'\"!?()$%/&’“”–—-]")
_tag = re.compile(r"</?[a-zA-Z][^>]{0,300}>")


@lru_cache(200_000)
def bare(line: str) -> tuple[str, str]:
    """The line in lower case without decoration and repeated space, and its leading marker."""
    text = " ".join(line.split())
    if "<" in text:
        text = _tag.sub(" ", text).strip() or text
    mark = ""
    if m := _lead.match(text):
        mark = "1." if m[0][0].isdigit() else m[0].strip()
        text = text[m.end() :]
    while m := _tail.search(text):
        text = text[: m.start()]
        if not text:
            break
    return text.lower().strip(), mark


@lru_cache(100_000)
def _full_cue(text: str) -> int:
    m = _cue.fullmatch(text)
    return int(m.lastgroup[1:]) if m else 0


def cue(text: str) -> int:
    """The kind that a bare line announces, or 0."""
    if text.partition(" ")[0] in FIRST or _free(text):
        return _full_cue(text)
    return 0


#: Code that no sentence holds, whatever words stand around it; and code or markup by shapes that a sentence may have too.
_sure_code = re.compile(r"\bfunction\s*\w*\(|=>|\bvar \w+\s*=|&&|\)\s*\{")
_code = re.compile(r"\breturn [^;]{0,80};|^[.#@]?[\w-]+\s*\{[^}]*[:;][^}]*\}|</?\w+[^>]*>\s*</?\w+")
_code_sign = re.compile(r"[({=&]").search
_garbled = re.compile("[\ufffd\u0080-\u00bf\u0160\u0161\u0152\u0153\u017d\u017e\u0192\u02c6\u02dc\u2020-\u2022\u2026\u2030\u20ac\u2122]")
_plain = re.compile(r" (?:the|a|an|of|to|and|in|for|is|on|at|de|la|el|los|que|y|en) ").search
_ascii_word = re.compile(r"[a-z]{3,}")
_vowel = re.compile(r"[aeiouy]").search


def is_junk(text: str) -> bool:
    """Unreadable remains: code and style rules, hardly any letters among symbols, words that no language has (encoded bytes, no vowels)."""
    if len(text) < 12:
        return False
    if _code_sign(text) and _sure_code.search(text):
        return True
    if _plain(text):
        return False
    if _code.search(text):
        return True
    letters = len(_letters.findall(text))
    dense = len(text) - text.count(" ")
    if letters < 0.35 * dense and len(_odd.findall(text)) > 0.25 * dense:
        return True
    words = text.split()
    longest = max(words, key=len)
    if len(longest) >= 24 and "://" not in longest and "@" not in longest and "..." not in longest and "___" not in longest:
        turns = sum(1 for a, b in zip(longest, longest[1:]) if a.islower() and b.isupper())
        return turns >= 4 or sum(c.isdigit() for c in longest) > 0.3 * len(longest) and letters < 0.8 * dense
    small = _ascii_word.findall(text)
    if len(small) >= 4 and sum(not _vowel(w) for w in small) >= 0.4 * len(small):
        return True
    return len(_garbled.findall(text)) > 0.25 * dense


def menu_bar(text: str) -> bool:
    """Several labels in one line, between bars or arrows."""
    parts = [p.strip() for p in _crumb.split(text) if p.strip()]
    if len(parts) < 2:
        return False
    known = sum(p in LABELS for p in parts)
    return known >= 2 and known >= 0.6 * len(parts)


def is_crumb(raw: str, text: str) -> bool:
    """A path of pages: starts at Home, parts between arrows, no sentence."""
    if not text.startswith(("home", "start", "inicio", "you are here", "main")):
        return False
    parts = [p.strip() for p in _crumb.split(raw.strip()) if p.strip()]
    return len(parts) >= 2 and parts[0].lower() in ("home", "start", "inicio", "you are here: home", "main")


def is_title(raw: str, text: str) -> bool:
    """Could stand in a box of related pages."""
    return len(text) >= 8 and not raw.rstrip().endswith((".", "?", "!", ";")) and "\t" not in raw and "|" not in raw and bool(_title.fullmatch(text))


def kinds(text: str, title: str | None = None, cut: bool = False) -> list[int]:
    """The kind of every line. title: the page's own; cut: the text was shortened, so that its last line may be incomplete."""
    raw = text.split("\n")
    n = len(raw)
    out = [BLANK] * n
    own = bare(title)[0] if title else None
    bares = [bare(x) for x in raw]
    for i, line in enumerate(raw):
        low, mark = bares[i]
        if not low:
            out[i] = BLANK if not line.strip() else JUNK if len(line.strip()) > 11 else LABEL
            continue
        if own and low == own:
            out[i] = HEADING
        elif k := cue(low):
            out[i] = k
        elif len(low) > 80 and low[-1] == "." and "|" not in line and "\t" not in line and "   " not in line and '","' not in line:
            out[i] = ITEM if mark and len(low) < 90 else JUNK if is_junk(line) else PROSE
        elif is_crumb(line, low):
            out[i] = CRUMB if not menu_bar(low) else MENU
        elif _bars(low) and menu_bar(low):
            out[i] = MENU
        elif low in LABELS:
            out[i] = MENU
        elif _action.fullmatch(low) and len(low.split()) <= 4:
            out[i] = LABEL
        else:
            out[i] = _body(line, low, mark)
    _boxes(raw, bares, out, own)
    _menus(raw, bares, out)
    if cut and n and raw[-1].strip():
        out[-1] = _cut(bares, out)
    return out


_number = re.compile(r"\d")


def _body(line: str, low: str, mark: str) -> int:
    if is_junk(line):
        return JUNK
    if line.count("|") >= 3 or _csv.match(line) or _pair.match(line) or len(_columns.findall(line.strip())) >= 2 or line.count("\t") >= 2 or _dots.search(line):
        return ROW
    tokens = low.split()
    words = len(tokens)
    if words >= 5 and not _plain(low) and sum(1 for t in tokens if _number.search(t)) >= (0.3 if words >= 12 else 0.4) * words:
        return ROW
    if low.count(";") >= 4 and not _plain(low) or low.count(" | ") >= 2:
        return ITEM
    stop = bool(_stop.search(line.rstrip()))
    if mark and (words <= 14 or not stop):
        return ITEM
    if stop and words >= 4 or words >= 14:
        return PROSE
    return LABEL


def clean_cuts(lines: list[str], kind: list[int]) -> list[int]:
    """The places i between lines i - 1 and i where what stands before needs no more than line i - 1 to judge what follows, and nothing to be judged.

    Line i - 1 is a sentence, row or junk, which ends boxes and menus, and none of the last three lines is an action that menus look
    for around them. The first and last line may be open; cuts that would rest on them are left out.
    """
    action = [bool(_action.fullmatch(bare(x)[0])) for x in lines]
    return [i for i in range(4, len(lines)) if kind[i - 1] in (PROSE, ROW, JUNK) and not any(action[i - 3 : i])]


def sentences(lines: list[str], kind: list[int], before: int = BLANK) -> tuple[int, int]:
    """Words in sentences, and in list items, table rows and unreadable remains; headings and lines that are no content count as neither.

    A short line belongs to the sentences if it has words that only sentences have, or goes on from such a line (text wrapped to
    a width); else it is an entry of a list. before: the kind of the line before the first.
    """
    prose = rest = 0
    for line, k in zip(lines, kind):
        if k == BLANK:
            before = BLANK
            continue
        if k >= MENU:
            continue
        n = len(line.split())
        if k == LABEL:
            text = line.strip()
            words = text.split()
            if before == PROSE and n > 3 and text[0].islower() and "  " not in text:
                k = PROSE
            elif not text.isupper() and not _stop.search(text) and ("  " in text or n >= 3 and sum(w[0].isupper() or w[0].isdigit() for w in words) >= 0.6 * n and not _title.fullmatch(text.lower())):
                k = ITEM
            elif before != PROSE and n <= 40 and _title.fullmatch(text.lower()):
                k = HEADING
            elif _plain(f" {text.lower()} ") or before == PROSE and (text[0].islower() or _stop.search(text)) or _stop.search(text) and n >= 2:
                k = PROSE
            else:
                k = ITEM
        if k == PROSE:
            prose += n
        elif k in (ITEM, ROW, JUNK):
            rest += n
        before = k
    return prose, rest


def _boxes(raw: list[str], bares: list[tuple[str, str]], out: list[int], own: str | None) -> None:
    """After the heading of a box, its entries: lines of one marker that read like titles."""
    i, n = 0, len(raw)
    while i < n:
        if out[i] != BOX:
            i += 1
            continue
        j, mark = i + 1, None
        while j < n and (mark or j - i <= BOX_PLAIN) and out[j] not in (BLANK, PROSE, ROW, JUNK) and out[j] < MENU:
            low, m = bares[j]
            if mark is None:
                mark = m
            if m != mark or (own and low == own and not m) or not is_title(raw[j], low):
                break
            out[j] = BOX_ITEM
            j += 1
        i = j


def _menus(raw: list[str], bares: list[tuple[str, str]], out: list[int]) -> None:
    """Single labels count as a menu in a run of labels; short actions count with the menu that they follow."""
    n = len(raw)
    i = 0
    while i < n:
        if out[i] == MENU:
            i += 1
            while i < n and out[i] == LABEL and _action.fullmatch(bares[i][0]):
                out[i] = MENU
                i += 1
        else:
            i += 1
    for i in range(n):
        if out[i] == LABEL and _action.fullmatch(bares[i][0]) and bares[i][0].split()[-1] not in ("county",):
            before = next((out[k] for k in range(i - 1, -1, -1) if out[k] != BLANK), None)
            like = [k for k in range(max(0, i - 3), min(n, i + 4)) if k != i and out[k] in (LABEL, MENU, ITEM) and _action.fullmatch(bares[k][0])]
            if before is None or before >= MENU or like or raw[i].rstrip().endswith("▸"):
                out[i] = MENU


_office = re.compile(r"[a-z' ]+ county o(?:f(?:f(?:i(?:c(?:e(?:,.*)?)?)?)?)?)?")


def _cut(bares: list[tuple[str, str]], out: list[int]) -> int:
    """The kind of an incomplete last line, by what it may become and what stands before it."""
    low, mark = bares[-1]
    before = next((k for k in reversed(out[:-1]) if k != BLANK), None)
    if not low or out[-1] >= MENU and (out[-1] != MENU or before is None or before >= MENU or len(low.split()) > 1):
        return out[-1]
    if before == MENU and (any(x.startswith(low) for x in LABELS) or re.fullmatch(rf"{_VERB}(?: .{{0,24}})?", low)):
        return MENU
    if before == BOX or before == BOX_ITEM and out[-2] == BOX_ITEM and (mark == bares[-2][1] != "" or not mark and out[-3:-2] == [BOX]):
        return BOX_ITEM
    if before is not None and before >= PROMPT and (len(low) < 5 or _office.fullmatch(low)) or _office.fullmatch(low) and "county off" in low:
        return OFFICE
    for s in STARTS:
        if len(low) >= 5 and (s.startswith(low) or low.startswith(s)):
            return PROMPT
    parts = [p for p in _crumb.split(low) if p]
    if len(parts) >= 3 and sum(p in LABELS for p in parts[:-1]) >= 2:
        return MENU
    return LABEL if out[-1] == MENU else out[-1]
