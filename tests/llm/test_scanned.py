from tidemark.llm import scanned

WORDS = {w: 500 for w in "the ballot board with registration training voters of was set aside and county office will a form must be sent before noon in comparator".split()} | {"closed": 300}
TEXT = """Page 12
COUNTY OFFICE RESULTS, OLD COUNTY
The b0ard of voters was set aside with the regis-
- 13 -
tration form. The county 0ffice will be
closed before noon.

A fraining form must be sent w!th the baIlot."""


def test_defects():
    got = scanned.defects(TEXT, None, scanned.Decoder(WORDS | {"board": 500, "results": 500, "old": 500}))
    assert sorted(got) == [(0, "furniture"), (1, "furniture"), (2, "misread"), (2, "split"), (3, "furniture"), (4, "misread"), (7, "misread")]


def test_counts_are_weighed_by_their_ratio():
    counts = WORDS | {"county": 49_838, "coiinty": 19, "training": 20_842, "fraining": 8, "ballot": 34_701, "ballof": 7, "house": 6000, "horse": 5900}
    text = "The coiinty office was set aside with\nthe fraining form and the ballof in\nthe house and the horse"
    for times in (1, 100, 1000):
        decoder = scanned.Decoder({w: times * n for w, n in counts.items()})
        assert scanned.defects(text, None, decoder) == [(0, "misread"), (1, "misread")], times
        out = scanned.repaired(text, None, decoder).split()
        assert {"county", "training", "ballot", "house", "horse"} <= set(out) and not {"coiinty", "fraining", "ballof"} & set(out), times


def test_the_cheapest_path_is_the_reading():
    decoder = scanned.Decoder(WORDS | {"today": 40, "to": 900, "day": 800, "mail": 300})
    text = "The ballot regis\ntration form of the coun ty\nofficewill be sent to\nday before the regis-\ntrat1on and the mail-\nin ballot"
    text = text.replace("coun ty", "coun ty office")
    decoder.lexicon["county"] = 500
    assert scanned.defects(text, None, decoder) == [(0, "split"), (3, "split")]
    out = scanned.repaired(text, None, decoder).split()
    assert out.count("registration") == 2 and "county" in out and "to" in out and "day" in out and "today" not in out
    assert "office will" in " ".join(out)
    # without the joint decoding nothing is found in the same text
    decoder.decode = lambda lines: []
    assert scanned.defects(text, None, decoder) == []


def test_a_path_costs_no_more_than_any_other():
    decoder = scanned.Decoder(WORDS)
    lines = [["The", "b0ard", "regis"], ["tration", "off", "ice", "ofthe"], ["registra-"], ["tion", "w1th"]]
    tokens = [t for x in lines for t in x]
    looks, ends = [decoder.look(t) for t in tokens], {2: False, 6: False, 7: False, 9: False}
    whole = decoder._stretch(tokens, looks, ends, 0, len(tokens))
    assert sorted(decoder.decode(lines)) == sorted(whole)
    assert [(i, k) for i, _, k in whole] == [(1, "misread"), (2, "bare"), (4, "spaced"), (6, "run"), (7, "hyphen"), (9, "misread")]


def test_paragraphs_of_any_number_of_lines():
    lines = ["the board of voters was set aside with the registration form and"] * 1500
    assert len(scanned.repaired("\n".join(lines), None, scanned.Decoder(WORDS)).split("\n\n")) == 1


def test_repair_gives_paragraphs():
    out = scanned.repaired(TEXT, None, scanned.Decoder(WORDS | {"board": 500}))
    assert "registration form." in out and "b0ard" not in out and "Page 12" not in out and len(out.split("\n\n")) == 2


def test_edge_cases(spark):
    decoder = scanned.Decoder({})
    for text in ("", "\n\n", "12", "-", "word-", "x" * 100_000, "1\n2\n3\n4\n5\n6"):
        scanned.defects(text, None, decoder)
        scanned.repaired(text, None, decoder)
    rows = [("a", TEXT, None, "document", "https://h/x.pdf"), ("a", TEXT, None, "document", "https://h/x.pdf"), ("b", None, None, "document", None), ("c", TEXT, None, "prose", None), (None, TEXT, None, "document", None)]
    rows += [(f"l{i}", "The board of voters was set aside with the registration form " * 3, None, "prose", None) for i in range(20)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "chunk_id string, text string, title string, page_classification string, source_url string, n int")
    got = [(r.chunk_id, r.line_no, r.defect) for r in scanned.find_defects(df).collect()]
    assert ("a", 2, "split") in got and ("a", 3, "furniture") in got and {g[0] for g in got} == {"a"} and len(got) == len(set(got))
    assert scanned.find_defects(df.limit(0)).count() == 0 and [r.chunk_id for r in scanned.repair(df).collect()] .count("a") == 1
