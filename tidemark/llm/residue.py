"""Template residue, error pages and filler.

1. Each text is read once, whole: unfilled template fields, leftovers of failed substitutions and filler label it at once; of the
   others, the body (its lines without navigation and notices of the site) becomes a masked string, and is labelled, as a trusted
   seed, where each of its sentences is an error, a demand for scripts, a login or waiting, or filler.
2. Copies are one body. A body that is near a labelled one is at most 1 / SIMILARITY as long, so bodies up to that length, as the
   labels reach, are compared: each is keyed by its rarest runs of words, as many as it takes for two bodies that reach SIMILARITY to
   have a common one, and all bodies with a common key are compared, in cells of bounded size. SimHash tables don't serve here: in
   bodies of so few words one other word turns more bits than any tables can allow for.
3. Pairs are verified by similarity of their runs of words, and trusted labels go along the connected components of what remains.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm import outline
from tidemark.operators.components import components
from tidemark.plans.materialize import materialize, small

#: Words per run and least similarity of a verified pair.
RUN, SIMILARITY = 5, 0.8
SIMILARITY_TENTHS = round(10 * SIMILARITY)
#: Bodies with a common run that are compared at once, about.
PART = 500

_name = r"[A-Za-z_][\w.-]*"
#: Unfilled fields and leftovers of substitutions (patterns of the common template languages).
FIELDS = re.compile(
    "|".join(
        (
            rf"\{{\{{\{{?\s*{_name}(?:\s*\|\s*\w+)?\s*\}}?\}}\}}", rf"\$\{{\s*{_name}\s*\}}", rf"<%[=-]?\s*{_name}\s*-?%>", rf"<<\s*{_name}\s*>>", rf"%%\s*{_name}\s*%%", rf"(?<![\w#])#{_name}#(?![\w#])", rf"\[\[\s*{_name}\s*\]\]",
            r"\[(?:INSERT|insert|Insert|ENTER|YOUR|Your|ADD|add|PLACEHOLDER)\b[^\]\n]{0,60}\]", r"\[(?:DATE|NAME|TITLE|TIME|PLACE|ADDRESS|PHONE|EMAIL|LOCATION|COUNTY|TEXT)(?: (?:TBD|HERE|TBA|GOES HERE))?\]", rf"(?<![\w@.])@{_name}@(?![\w@])", rf"(?<!\w)__{_name}?[A-Za-z]__(?!\w)",
            rf"(?<![\w{{$%#(=,:;])\{{{_name}\}}(?![\w}}])", r"\$\$?MISSING\$?\$?", r"\[object Object\]", r"\((?:null|NULL|undefined|None|nil)\)", r"<(?:null|undefined)>", r"\bTODO:", r"\bFIXME\b", r"(?<![\w\"'“‘-])(?:undefined|NaN)(?![\w\"'”’(])", r"%\((?:\w+)\)s", r"\bLorem ipsum dolor\b", r"#(?:REF|VALUE|NAME|N/A|DIV/0)[!?]", r"\{%\s*\w+[^%\n]{0,60}%\}",
        )
    )
)
#: Characters or words one of which every field has; texts without them are not searched.
_field_hint = re.compile(r"\{[\w{% ]|<[<%]|%%|\[\[|\[(?:INS|ins|Ins|ENT|YOUR|Your|ADD|add|PLA|DATE|NAME|TITLE|TIME|ADDR|PHONE|EMAIL|LOC|COUNTY|TEXT|object)|#[A-Za-z_]|@[A-Za-z_]|__[A-Za-z]|\$\$?MISS|TODO|FIXME|undefined|NaN|null\)|NULL\)|None\)|nil\)|<null|%\(|Lorem")

#: What notices say; a line that fully reads like one of these, whatever the rest of it, is a notice.
NOTICES = re.compile(
    "|".join(
        (
            r"(?:http )?(?:status|error)?(?: code)? ?[:#]?\s?[45]\d\d\b.{0,110}", r".{0,60}\b(?:404|403|401|500|502|503|504)\b.{0,20}(?:not found|forbidden|unauthori[sz]ed|error|unavailable|timeout|gateway).{0,80}",
            r"(?:sorry,? |oops!? ?|whoops!? ?)?(?:the|this|that) (?:page|document|file|resource|site|link|content|address|application|view)\b.{0,60}\b(?:not be found|not found|no longer|does(?: not|n't) exist|moved|removed|unavailable|not available|been deleted|expired|cannot be displayed|unexpected|will not start|went wrong).{0,80}",
            r"(?:oops|whoops|sorry|uh-oh)[!,. ].{0,90}", r".{0,40}service (?:is )?(?:temporarily )?unavailable.{0,80}", r"bad gateway\b.{0,80}", r"(?:internal )?server error\b.{0,60}", r"too many requests\b.{0,60}", r"(?:access|permission) (?:is )?denied\b.{0,60}", r".{0,10}you do not have (?:permission|access)\b.{0,60}",
            r"(?:index of )?\S+ (?:is )?forbidden\.?", r"(?:runtime|unhandled|fatal|uncaught|null pointer)?\s?(?:exception|error)\b.{0,30}(?:in|at|on|#|\d|:).{0,90}", r"(?:database|connection|request|session|gateway|socket)\b.{0,40}(?:refused|timed out|timeout|failed|expired|reset|lost|aborted).{0,70}",
            r"an? (?:unexpected|unknown|internal|fatal|application) error\b.{0,90}", r"unable to (?:render|load|connect|display|process|open|complete|retrieve|establish)\b.{0,80}", r"(?:failed|could not|cannot) (?:to )?(?:load|render|connect|open|display|process|establish|retrieve)\b.{0,80}", r"something went wrong\b.{0,80}",
            r".{0,60}(?:enable|turn on|activate|allow|requires?|need(?:s)?(?: to turn on)?|without|switch(?:ed)? (?:on|off)|relies on|support|blocked)\b.{0,20}\b(?:java\s?scripts?|scripts?|scripting|cookies)\b.{0,90}", r"(?:java\s?scripts?|scripts?|scripting|cookies|noscript)\b.{0,30}(?:disabled|required|blocked|not (?:supported|enabled|available)|must be|switched off|is off|are off|:).{0,80}",
            r"(?:checking|verifying|validating) (?:your|if|that|the)\b.{0,90}", r"(?:please )?(?:verify|confirm|prove)(?: that)? you are (?:a )?(?:human|not a robot)\b.{0,80}", r"(?:you are being|you will be|now) redirect(?:ed|ing)\b.{0,90}", r"redirecting\b.{0,80}", r"if (?:nothing happens|you are not redirected)\b.{0,60}",
            r"(?:your|the|this) session (?:has )?(?:expired|timed out|ended)\b.{0,80}", r"(?:please )?(?:sign|log) ?in (?:again )?(?:to|first|before)\b.{0,60}", r"(?:you must|you need to) (?:be )?(?:sign|log)(?:ged|ed)? ?in\b.{0,60}", r"(?:authentication|login|log-in|sign-in|registration) (?:is )?required\b.{0,60}",
            r"(?:we are|the site is|site|currently|this site is) ?(?:down|offline|closed)?.{0,20}\b(?:scheduled |under |planned )?maintenance\b.{0,60}", r"(?:please )?(?:wait|stand by|hold on|loading)\b.{0,60}", r"(?:please )?(?:try again|come back|reload|refresh)\b.{0,60}", r"loading\.{0,3}", r"nothing (?:lives|here|to see|found|was found)\b.{0,60}",
            r"la (?:sesión|página|pagina|sesion)\b.{0,40}(?:caducado|expirado|no existe|retirada|no se encuentra|no encontrada|disponible).{0,60}", r"(?:error|acceso|servicio|se requiere|debe|habilite|active)\b.{0,20}(?:denegado|no disponible|javascript|iniciar sesión|cookies|interno).{0,60}", r"\d{3} (?:not found|forbidden|error|bad gateway|unauthorized|gone)\b.{0,80}", r"gone\b.{0,20}|not found\.?|forbidden\.?|no results(?: found)?\.?",
            r"(?:reference|request|incident|error|ray|trace|correlation)(?: id| number| code)?\s?[:#]\s?[\w-]{4,}.{0,20}",
            r"(?:lorem|ipsum|dolor|sit|amet)\b.{0,400}", r"(?:asdf|qwerty|test|foo|bar|blah|xxx|abc|lorem|dummy|sample|placeholder|draft|slot)(?:[ .,]+(?:asdf|qwerty|test|foo|bar|blah|xxx|abc|ipsum|dummy|sample|text|block|slot|draft|placeholder|#|\d+))*\.?",
            r"(?:this is )?(?:sample|dummy|placeholder|filler|example|test) (?:text|content|copy|paragraph|block|heading|page)\b.{0,60}", r"(?:type|write|enter|insert|add|put|paste) your (?:\w+ )?(?:paragraph|text|content|heading|title|copy|description|story|words?)(?: goes)? here\b.{0,60}", r"your (?:\w+ )?(?:heading|text|title|content|paragraph|description|logo)(?: goes)? here\b.{0,60}",
            r"placeholder for\b.{0,80}", r"(?:text|content|heading|copy) (?:goes|to come|coming|follows) (?:here|soon)?\b.{0,40}", r"coming soon\b.{0,40}|under construction\b.{0,60}", r"(?:insert|replace) (?:this )?(?:text|content|image|copy)\b.{0,60}",
        )
    )
)
#: Short headings that go with a notice and say nothing by themselves.
NEUTRAL = re.compile(r"(?:whoops|oops|sorry|error|notice|warning|attention|please wait|alert|message|aviso|problem|info|information)[!.:]?")
#: Words of the usual filler text (fixed values).
FILLER = frozenset(
    """lorem ipsum dolor sit amet consectetur adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in
    reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum""".split()
)
#: Parts of words that every notice has one of; texts without them get no closer look for notices.
HINTS = """not found|404|403|401|500|502|503|504|forbidden|denied|permission|unavailable|try again|gateway|error|exception|timed out|timeout|refused|expired|script|cookie|redirect|too many|human|robot|maintenance|checking your|verif|sign in|log in|login|loading|moved|removed|no longer
oops|whoops|went wrong|unable to|could not|lives at|retirada|caducad|no existe|denegado|lorem|ipsum|asdf|qwerty|test|dummy|sample|placeholder|goes here|here|paragraph|coming soon|construction|gone|wait|no results|blah|javascript|offline|status""".replace("\n", "|").split("|")

_hex = re.compile(r"\b(?=[\w-]*\d)[0-9a-f]{4,}(?:-[0-9a-f]{2,})*\b|\d+")
_word = re.compile(r"[^\W_]+|#")
_split = re.compile(r"(?<=[.!?])\s+")


@lru_cache(1)
def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for h in HINTS:
        a.add_word(h, h)
    a.make_automaton()
    return a


def unfilled(text: str) -> bool:
    """At least one unfilled field or leftover of a failed substitution; code, style rules and blanks to fill in by hand don't count."""
    if not _field_hint.search(text):
        return False
    for m in FIELDS.finditer(text):
        a, b = text.rfind("\n", 0, m.start()) + 1, text.find("\n", m.end())
        line = text[a : b if b >= 0 else len(text)]
        if not outline.is_junk(line.replace(m[0], "field")):
            return True
    return False


def filler(text: str) -> bool:
    """Mostly words of filler text."""
    words = _word.findall(text.lower())
    return len(words) >= 8 and sum(w in FILLER for w in words) >= 0.6 * len(words)


def body(text: str, title: str | None, page: bool, kinds: list[int] | None = None) -> list[str]:
    """The lines that are content, bare; pages lose navigation and notices. kinds: those of outline.kinds(text, title), if known."""
    kinds = outline.kinds(text, title) if kinds is None else kinds
    own = outline.bare(title)[0] if title else None
    out = []
    for line, k in zip(text.split("\n"), kinds):
        if k == outline.BOX or k == outline.BOX_ITEM:
            continue
        low = outline.bare(line)[0]
        if not low or low == own or page and k >= outline.MENU and not NOTICES.fullmatch(low):
            continue
        if line.startswith("[") and line.rstrip().endswith("]"):
            continue
        out.append(low)
    return out


def seed(lines: list[str]) -> bool:
    """Every sentence is a notice or filler, and at least one says so by itself."""
    told = False
    for line in lines:
        if NEUTRAL.fullmatch(line) or len(line) <= 3:
            continue
        if NOTICES.fullmatch(line):
            told = True
            continue
        parts = _split.split(line)
        good = [bool(NOTICES.fullmatch(p)) for p in parts]
        if len(parts) > 1 and (all(good) or sum(good) * 2 > len(parts) and len(line.split()) <= 30):
            told = True
            continue
        return False
    return told


def similar(a: str, b: str) -> bool:
    """Runs of RUN words in common, by SIMILARITY; texts with fewer words must be the same."""
    x, y = a.split(), b.split()
    if x == y:
        return True
    m, n = ({tuple(w[i : i + RUN]) for i in range(len(w) - RUN + 1)} for w in (x, y))
    return bool(m and n) and len(m & n) >= SIMILARITY * len(m | n)


def judge(text: str, title: str | None, page: bool, kinds: list[int] | None = None) -> tuple[bool, bool, str | None, int]:
    """(sure, trusted, body, words): sure is a field or filler; trusted a seed; body the masked words of what is content, null if sure or without words."""
    if unfilled(text):
        return True, True, None, 0
    lines = body(text, title, page, kinds)
    low = text.lower()
    if "ipsum" in low and filler("\n".join(lines)):
        return True, True, None, 0
    words = _word.findall(_hex.sub("#", " ".join(lines)))
    if not words:
        return False, False, None, 0
    # without a hint it is no seed, but may still be near one
    return False, next(_automaton().iter(low), None) is not None and seed(lines), " ".join(words), len(words)


READ = "sure boolean, trusted boolean, body string, words int"


def read_texts(batch: pa.RecordBatch, kinds: list[list[int]] | None = None) -> list[pa.Array]:
    """The columns READ of a batch (id, text, title, class); kinds: those of the texts, if known."""
    rows = [judge(t, ti, c != "document", kinds[i] if kinds else None) for i, (t, ti, c) in enumerate(zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))))]
    return [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.bool_(), pa.bool_(), pa.string(), pa.int32()))]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), *read_texts(batch)], ["id", "sure", "trusted", "body", "words"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = [(a, b) for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if similar(a, b)]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in good], pa.string()), pa.array([x[1] for x in good], pa.string())], ["a", "b"])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(body) -> (h, runs): a body's hash and the hashes of its runs. Bodies of fewer words than a run are near no other."""
    for batch in batches:
        h, runs = [], []
        for text in batch.column(0).to_pylist():
            w = text.split()
            if len(w) >= RUN:
                h.append(xxhash.xxh64_intdigest(text) - 2**63)
                runs.append(list({xxhash.xxh64_intdigest(" ".join(w[i : i + RUN])) - 2**63 for i in range(len(w) - RUN + 1)}))
        yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(runs, pa.list_(pa.int64()))], ["h", "runs"])


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh64_intdigest(t) - 2**63 for t in batch.column(0).to_pylist()], pa.int64()), batch.column(0)], ["h", "body"])


def near_bodies(bodies: DataFrame) -> DataFrame:
    """(a, b): all pairs of bodies that are similar(), by common runs and verification. bodies: (body, ...), body unique."""
    each = materialize(bodies.select("body").mapInArrow(_keys, "h bigint, runs array<bigint>").select("h", F.size("runs").alias("size"), F.explode("runs").alias("run")), "runs")
    counts = each.groupBy("run").agg(F.count("*").alias("n"))
    # in any one order, here from the rarest run on, two sets that reach SIMILARITY meet in the first size - least + 1 of each
    least = F.ceil(F.col("size") * SIMILARITY_TENTHS / 10).cast("int")
    prefix = each.join(counts, "run").withColumn("place", F.row_number().over(Window.partitionBy("h").orderBy("n", "run")))
    prefix = materialize(prefix.filter((F.col("place") <= F.col("size") - least + 1) & (F.col("n") > 1)).select("run", "h", "size"), "prefixes")
    # a run's bodies are dealt to parts of about PART, and each pair of parts is a cell of its own
    parts = prefix.groupBy("run").agg(F.count("*").alias("n")).filter("n > 1").select("run", F.ceil(F.col("n") / PART).cast("int").alias("parts"))
    dealt = prefix.join(parts, "run").withColumn("part", F.pmod("h", "parts").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = dealt.select("run", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "h", "size", "part")
    x, y = (cells.withColumnsRenamed({c: f"{c}_{side}" for c in ("h", "size", "part")}) for side in "xy")
    once = (F.col("part_x") < F.col("part_y")) | (F.col("i") == F.col("j")) & (F.col("h_x") < F.col("h_y"))
    fit = F.least("size_x", "size_y") * 10 >= F.greatest("size_x", "size_y") * SIMILARITY_TENTHS
    met = x.join(y, ["run", "i", "j"]).filter(once & fit).select(F.least("h_x", "h_y").alias("h_x"), F.greatest("h_x", "h_y").alias("h_y")).distinct()
    # pairs are far fewer than bodies
    named = bodies.select("body").mapInArrow(_named, "h bigint, body string")
    pairs = met.join(named.withColumnsRenamed({"h": "h_x", "body": "x"}), "h_x").join(named.withColumnsRenamed({"h": "h_y", "body": "y"}), "h_y")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).mapInArrow(_verified, "a string, b string")


def labelled_bodies(read: DataFrame) -> DataFrame | None:
    """(body): the trusted bodies and those that labels reach along near bodies; None without a trusted body. read: (id, READ...), materialised."""
    seeds = materialize(read.filter("trusted and body is not null").select("body", "words").distinct(), "seeds")
    reach = seeds.agg(F.max("words")).first()[0]
    if reach is None:
        return None
    while True:
        # a body of w words has w - RUN + 1 runs, and its near ones at most 1 / SIMILARITY as many
        bound = (max(reach, RUN) - RUN + 1) * 10 // SIMILARITY_TENTHS + RUN - 1
        bodies = materialize(read.filter(F.col("body").isNotNull() & (F.col("words") <= bound)).groupBy("body").agg(F.max("trusted").alias("trusted"), F.max("words").alias("words")), "bodies")
        pairs = materialize(near_bodies(bodies), "near")
        if pairs.isEmpty():
            return seeds.select("body")
        groups = components(pairs)
        trusted = bodies.filter("trusted").select("body")
        marked = groups.join(groups.join(trusted, groups["node"] == trusted["body"]).select("component").distinct(), "component", "left_semi").select(F.col("node").alias("body"))
        marked = materialize(seeds.select("body").unionByName(marked).distinct(), "labelled")
        longest = marked.join(bodies.select("body", "words"), "body").agg(F.max("words")).first()[0]
        if longest <= reach:
            return marked
        reach = longest


def residue_ids(read: DataFrame) -> DataFrame:
    """(id) of the residue among the read texts, once each. read: (id, READ...), materialised."""
    sure = read.filter("sure").select("id")
    bodies = labelled_bodies(read)
    if bodies is None:
        return sure.distinct()
    return sure.unionByName(read.join(small(materialize(bodies, "labelled")), "body", "left_semi").select("id")).distinct()


def find_residue(chunks: DataFrame) -> DataFrame:
    """chunk_id of the chunks that are an error message, a notice or filler, or have an unfilled field.

    Null texts, empty texts and null ids are left out; an id delivered twice is one row; ties don't occur; an empty table gives no
    rows. http_status is not used: it is wrong in both directions. Other columns don't matter.
    """
    rows = chunks.filter(F.col("chunk_id").isNotNull() & (F.trim("text") != "")).select("chunk_id", "text", "title", "page_classification")
    kind = rows.schema["chunk_id"].dataType.simpleString()
    read = materialize(rows.mapInArrow(_read, f"id {kind}, {READ}"), "residue")
    return residue_ids(read).select(F.col("id").alias("chunk_id"))
