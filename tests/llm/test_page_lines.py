import random
from itertools import combinations

from tidemark.llm import outline, page_content, quality, residue

PAGE = """Skip to Content
Home
Voter Registration
Print Precinct Maps
Home › Vote by Mail › Some page
Your privacy matters. this website collects limited data; choose Accept All.
The drop box on Main Street is emptied daily by voters who have moved. It opens at noon.
See also
- Recount of votes in Oldtown
- Questions about seals in Oldtown County
The privacy notice of the portal explains that cookies are used only to keep a voter signed in.
• Goriport Hall
| A | B | C |
Tags: one, two
Previous: Sheriff results, Old County
Updated March 12, 2023"""


def test_lines_of_a_page():
    bad = [i for i, k in enumerate(outline.kinds(PAGE, "Some page")) if k >= outline.MENU]
    assert bad == [0, 1, 2, 3, 4, 5, 7, 8, 9, 13, 14, 15]


def test_variants_and_edge_cases():
    for line in ("SUBSCRIBE TO OUR WEEKLY BULLETIN WITH 2 CLICKS", "  Was  this  page  helpful?  14  people  said  yes »", "| Reading time: 4 minutes |", "• Copyright 2026 the Office. All rights reserved..."):
        assert outline.kinds(line)[0] >= outline.MENU, line
    assert outline.kinds("") == [outline.BLANK] and outline.kinds("\n \n") == [outline.BLANK] * 3
    assert len(outline.kinds("x " * 200_000)) == 1
    assert outline.kinds("Page titles in Old Town\nA page ends.", "Page titles in Old Town")[0] == outline.HEADING


#: What other pages of a corpus hold; ratios are those of the corpus.
PROSE = "\n".join(["The registrar opens the drop box every evening with two judges, counts the envelopes, and seals the box again before they leave the site."] * 6)


def test_boilerplate_table(spark):
    more = [(f"p{k}", PROSE, None, "prose", 1) for k in range(10)]
    chunks = spark.createDataFrame([*more, ("c1", PAGE, "Some page", "prose", 1), ("c1", PAGE, "Some page", "prose", 1), ("c2", None, None, None, 1), ("c3", PAGE, None, "document", 1), ("c4", "", None, "faq", 1), (None, PAGE, None, "faq", 1)], "chunk_id string, text string, title string, page_classification string, path int")
    pages = spark.createDataFrame([(7, "html", "crawled", "Skip to Content\nA sentence of the page ends here.", None), (8, "pdf", "crawled", "Skip to Content", None), (9, "html", "failed", "Skip to Content", None), (10, "html", "crawled", None, None)], "id long, content_type string, crawl_status string, extracted_snippet string, title string")
    found = {}
    for r in page_content.find_boilerplate(chunks, pages).collect():
        found.setdefault((r.record_kind, r.record_key), []).append(r.line_no)
    assert {k: sorted(v) for k, v in found.items()} == {("chunk", "c1"): [0, 1, 2, 3, 4, 5, 7, 8, 9, 13, 14, 15], ("page", "7"): [0]}
    kept = {(r.record_kind, r.record_key): r.text for r in page_content.main_content(chunks, pages).collect()}
    assert kept["page", "7"] == "A sentence of the page ends here." and kept["chunk", "c4"] == ""
    assert page_content.find_boilerplate(chunks.limit(0), pages.limit(0)).count() == 0


def merged(text, title, page, size, draw):
    cut = [text[i : i + size] for i in range(0, len(text), size)] or [""]
    parts = [quality.partial(t, i == 0, i == len(cut) - 1, title, page) for i, t in enumerate(cut)]
    while len(parts) > 1:  # neighbours in any order of merging
        i = draw.randrange(len(parts) - 1)
        parts[i : i + 2] = [quality.join(parts[i], parts[i + 1])]
    return quality.closed(parts[0])


def test_statistics_split_and_merged():
    text = "The first line of the text ends.\n- Item one\nword " + "and more of the words in this line " * 30 + "\nLast, line; ends!\n\ntail"
    draw = random.Random(3)
    for body in (text, PAGE, "\n".join([PAGE, text] * 4), "no line end", "", "\n\n\n", "\n".join(f"- Place {k}" for k in range(60)), "See also\n" + "\n".join(f"- Recount of votes in Town {k}" for k in range(30)) + "\n" + PAGE):
        for page in (False, True):
            whole = quality.closed(quality.partial(body, True, True, "Some page", page))
            for size in (3, 7, 50, 200, 1000):
                assert merged(body, "Some page", page, size, draw) == whole, (body[:40], page, size)
    words = text.split()
    whole = quality.closed(quality.partial(text, True, True, None, False))
    assert whole[quality.COUNTS.index("words")] == len(words) and whole[quality.COUNTS.index("word_chars")] == sum(map(len, words))


def test_statistics_do_not_depend_on_the_segment(spark, monkeypatch):
    """All columns of all texts of a test table, cut at a size at which most texts are cut."""
    rows = spark.read.parquet("/root/testdata/sf0.001/chunks.parquet")
    want = sorted(map(tuple, quality.statistics(rows, title="title", kind="page_classification").collect()))
    monkeypatch.setattr(quality, "SEGMENT", 300)
    monkeypatch.setattr(quality, "WIDTH", 3)
    assert sorted(map(tuple, quality.statistics(rows, title="title", kind="page_classification").collect())) == want


def test_statistics_table(spark):
    huge = ("Every word of this sentence counts for the sum. " * 40 + "\n") * 500
    rows = [("a", "The cat sat on the mat."), ("a", "The cat sat on the mat."), ("n", None), ("e", ""), ("h", huge), ("l", "- one\n- two\n- three")]
    got = {r.chunk_id: r for r in quality.statistics(spark.createDataFrame([(*r, 0) for r in rows], "chunk_id string, text string, words int")).collect()}
    assert set(got) == {"a", "e", "h", "l"} and got["a"].words == 6 and got["a"].rest_share == 0 and got["e"].words == 0 and got["e"].mean_word is None
    assert got["h"].words == len(huge.split()) and got["h"].lines == 500 and got["l"].rest_share == 1


def test_residue_texts():
    for t in ("Call {{county_name}} now.", "Dear [INSERT name],", "opens at ${x.y} today", "the <% = z %> <%= z %>", "the undefined judge", "a $$MISSING$$ hearing", "see [object Object]", "on [DATE TBD]", "by @boardSeal@ and", "TODO: text", "is {deadline} now", "In (null) County"):
        assert residue.unfilled(t), t
    for t in ("Write it in the blank, for example Precinct ______.", "[Title of page — heading]", "columns {county, precinct, votes} and", "var a=function(e){return e&&t?[1]:null;};", "mail me @ home", ".a-1{margin:1px;color:#fff;float:left}", "issue #5 and #6", "a null hypothesis"):
        assert not residue.unfilled(t), t
    assert residue.seed(["whoops", "404 not found"]) and residue.seed(["please enable javascript in your browser to view this content."])
    assert not residue.seed(["the office is open from nine to five and closed on sundays."]) and not residue.seed(["notice"])


def test_residue_table(spark):
    rows = [("a", "Bad gateway: the upstream server gave no answer."), ("a", "Bad gateway: the upstream server gave no answer."), ("b", "Hello {{name}}, " + "words of the letter " * 900), ("c", "The judge opened the office at nine."), ("d", None), ("e", " "), ("f", "Lorem ipsum dolor sit amet " * 30)]
    df = spark.createDataFrame([(*r, None, "prose", "x") for r in rows], "chunk_id string, text string, title string, page_classification string, body string")
    assert sorted(r.chunk_id for r in residue.find_residue(df).collect()) == ["a", "b", "f"]
    assert residue.find_residue(df.limit(0)).count() == 0


HELP = "the application needs a modern reader with several features that this one does not have so ask the help desk of your town hall or come again when the page was made for it"


def test_labels_go_along_near_copies(spark, monkeypatch):
    """A body that no pattern knows is found because it is near a trusted one, over a chain, and not without the components."""
    seed = "Please enable javascript in your browser to view this content. Too many requests from your network. Your session has expired. Bad gateway, the upstream server gave no answer. You must log in to view this page. Please wait while the page is made ready."
    more = " Quartz harbor melon tulip seven. Amber kettle walks uphill twice. Nine paper boats drift past. Old maps fold badly now.".split(". ")
    chain = [seed + ". ".join(more[:k]) for k in range(5)]
    rows = [(str(k), t, None, "prose") for k, t in enumerate(chain)] + [("far", HELP, None, "prose"), ("long", (HELP + ". ") * 300, None, "prose")]
    assert residue.judge(chain[0], None, False)[1] and not any(residue.judge(t, None, False)[1] for t in chain[1:])
    masked = [residue.judge(t, None, False)[2] for t in chain]
    df = spark.createDataFrame(rows, "chunk_id string, text string, title string, page_classification string")
    assert not residue.similar(masked[0], masked[-1]) and all(map(residue.similar, masked, masked[1:]))
    assert sorted(r.chunk_id for r in residue.find_residue(df).collect()) == ["0", "1", "2", "3", "4"]
    monkeypatch.setattr(residue, "near_bodies", lambda bodies: spark.createDataFrame([], "a string, b string"))
    assert [r.chunk_id for r in residue.find_residue(df).collect()] == ["0"]


def test_long_texts_are_read_whole():
    menu = "\n".join(f"• Voting\n• Home\n• Contact Us" for _ in range(400))
    assert residue.judge(menu + "\nBad gateway: the upstream server gave no answer.", None, True)[1]
    notice = "\n".join(["Service temporarily unavailable. Please try again in a few minutes."] * 60)
    assert residue.judge(notice, None, False)[1] and not residue.judge(notice + "\nThe judge opened the office at nine.", None, False)[1]


def _pairs(spark, bodies):
    rows = [(b, False) for b in bodies]
    return {tuple(sorted(r)) for r in residue.near_bodies(spark.createDataFrame(rows, "body string, trusted boolean")).collect()}


def test_all_bodies_with_a_common_run_are_compared(spark, monkeypatch):
    base = [f"w{k}" for k in range(60)]
    bodies = [" ".join(base[:59] + [f"x{n}"]) for n in range(40)]
    want = {tuple(sorted(p)) for p in combinations(bodies, 2)}
    assert _pairs(spark, bodies) == want
    monkeypatch.setattr(residue, "PART", 7, raising=False)
    assert _pairs(spark, bodies) == want


def test_near_bodies_are_those_of_brute_force(spark):
    draw = random.Random(5)
    bodies = {"one two three four", "one two three four five", "one two three four five six"}
    for size in (9, 20, 30, 45, 60):
        for _ in range(4):
            base = [draw.choice("abcdefghijklmnopqrstuvwxyz") + str(draw.randrange(30)) for _ in range(size)]
            for change in range(6):
                words = list(base)
                for _ in range(change % 3):
                    words[draw.randrange(size)] = f"z{draw.randrange(99)}"
                bodies.add(" ".join(words[: size - change // 3]))
    want = {tuple(sorted(p)) for p in combinations(sorted(bodies), 2) if residue.similar(*p)}
    assert len(want) > 40 and _pairs(spark, sorted(bodies)) == want


def test_no_prose_leaves_out_residue(spark):
    rows = [("a", "- one place\n- two places\n- three places"), ("b", "- one {{place}}\n- two\n- three"), ("c", "This is a sentence. And this is another one.")]
    df = spark.createDataFrame([(*r, None, "prose") for r in rows], "chunk_id string, text string, title string, page_classification string")
    assert [r.chunk_id for r in quality.find_no_prose(df).collect()] == ["a"]


def test_paths_are_rejected_by_their_ratios_alone(spark, monkeypatch):
    """Without the ratios nothing is rejected; and a cookie box that holds the page's text in full sentences is kept."""
    chunks = spark.createDataFrame([(f"c{k}", PAGE + "\n" + PROSE, "Some page", "prose") for k in range(40)], "chunk_id string, text string, title string, page_classification string")
    pages = spark.createDataFrame([], "id long, content_type string, crawl_status string, extracted_snippet string, title string")
    assert page_content.find_boilerplate(chunks, pages).count() == 40 * 12
    monkeypatch.setattr(page_content, "WEIGHTS", (0.0, 0.0))
    assert page_content.find_boilerplate(chunks, pages).count() == 0
    monkeypatch.undo()
    told = "We use cookies and other words in this text. " + "The office counts them, one by one; it reports, in full, what it finds. " * 8
    kept = spark.createDataFrame([(f"c{k}", f"{told}\nHome\nVoting\nA short sentence ends here now.", None, "prose") for k in range(40)], "chunk_id string, text string, title string, page_classification string")
    assert {r.line_no for r in page_content.find_boilerplate(kept, pages).collect()} == {1, 2}
