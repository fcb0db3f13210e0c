import io
import zipfile

from tidemark.sources import files, html, html_queries

FAQ = """<html><head><title> Help  page </title></head><body><nav><a href='/home'>Home</a></nav><main>
<dl><dt>How do I vote?</dt><dd>Go to the <b>hall</b>.</dd><dd>Bring a card.</dd><dt>Where is it?</dt><dd>On Main Street.</dd><dt>Notes</dt><dd>None.</dd></dl>
<p>See <a href="../x?a=1#t">this one</a> or <a href="mailto:a@b.c">mail</a>.</p></main><footer>Foot</footer></body></html>"""
TABLE = """<table><caption>Sites</caption><thead><tr><th>Name</th><th>Town</th></tr></thead><tbody><tr><td>A</td><td>X<td></tr><tr><td>B</td><td>Y</td></tr><tr><td></td><td></td></tr><tr><td>C</td><td></td></tr></tbody></table>
<table><tr><th>only</th></tr></table><table><tr><th>row</th><td>1</td></tr></table>"""


def test_parts_of_a_page():
    root = html.parse(FAQ)
    assert html.title(root) == "Help page" and "Foot" not in html.main_text(root) and "Home" not in html.main_text(root)
    assert [x["href"] for x in html.links(root, "https://h.example/a/b/c.html")] == ["https://h.example/home", "https://h.example/a/x?a=1#t"]
    assert html.breadcrumb(root, "https://h/early-voting/my_page") == ["Early Voting", "My Page"]
    assert html.structure(root) == "faq" and html.structure(html.parse(TABLE * 2)) == "table_data" and html.structure(html.parse("")) is None


def test_tables():
    got = html.table_rows(html.parse(TABLE))
    assert got[0]["rows"] == ["A | X", "Name: B | Town: Y", "Name: C"] or got[0]["rows"] == ["Name: A | Town: X", "Name: B | Town: Y", "Name: C"]
    assert got[-1]["rows"] == ["row | 1"] and len(got) == 2
    chunk = html.table_chunks(html.parse(TABLE))[0]
    assert chunk["text"].startswith("[Sites]\n") and (chunk["row_start"], chunk["row_end"]) == (0, 2)


def test_question_pairs():
    pairs, rest = html.question_pairs(FAQ)
    assert [(p["question"], p["answer"]) for p in pairs] == [("How do I vote?", "Go to the hall . Bring a card."), ("Where is it?", "On Main Street.")] and rest == ""
    rumors = "<details><summary>Mail</summary>" + "Rumor: one two three four five six. Fact: it is not so at all here. Rumor: seven eight nine. Fact: that is wrong as well." + "</details>"
    pairs, _ = html.question_pairs(rumors)
    assert [p["text"] for p in pairs] == ["[Mail]\nRumor: one two three four five six.\nFact: it is not so at all here.", "[Mail]\nRumor: seven eight nine.\nFact: that is wrong as well."]
    heads = "".join(f"<h3>What is {x}?</h3><p>It is {x} itself.</p>" for x in "abc") + "<h2>End</h2>"
    assert len(html.question_pairs(heads)[0]) == 3
    bold = "".join(f"<p><strong>Is it {x}?</strong> Yes, {x}.</p>" for x in "ab")
    assert [p["answer"] for p in html.question_pairs(bold)[0]] == ["Yes, a.", "Yes, b."]
    menu = "<details><summary>Menu</summary><a>One</a><a>Two</a></details>" * 3
    assert html.question_pairs(menu) == ([], "") and html.question_pairs("") == ([], "")


def test_hidden_mail_address():
    key, plain = 0x2A, b"a@b.c"
    coded = bytes([key, *(b ^ key for b in plain)]).hex()
    assert html.decoded_emails(f'x <a href="#" data-cfemail="{coded}">[hidden]</a>') == "x a@b.c"
    assert "data-cfemail" in html.decoded_emails('<span data-cfemail="abc">q</span>')


def test_pages_table(spark):
    df = spark.createDataFrame([("https://h/a", FAQ, 1), ("https://h/b", None, 2), ("https://h/c", TABLE, 3)], "url string, html string, text int")
    got = {r.url: r for r in html.read_pages(df).collect()}
    assert got["https://h/a"].title == "Help page" and len(got["https://h/a"].pairs) == 2 and got["https://h/b"].text is None and got["https://h/b"].links == [] and len(got["https://h/c"].tables) == 2


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, t in parts.items():
            z.writestr(n, t)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
P = lambda t, s=None: f'<w:p>{f"<w:pPr><w:pStyle w:val=\"{s}\"/></w:pPr>" if s else ""}<w:r><w:t>{t}</w:t></w:r></w:p>'
DOCX = zipped({"word/document.xml": f"<w:document {W}><w:body>{P('Top', 'Heading1')}{P('one')}{P('Sub', 'Heading2')}{P('two')}{P('Next', 'Heading1')}{P('three')}<w:tbl><w:tr><w:tc>{P('N')}</w:tc><w:tc>{P('V')}</w:tc></w:tr><w:tr><w:tc>{P('a')}</w:tc><w:tc>{P('1')}</w:tc></w:tr></w:tbl></w:body></w:document>"})
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def xlsx(n):
    rows = "".join(f'<row r="{i}"><c r="A{i}" t="s"><v>0</v></c><c r="C{i}"><v>{i}</v></c></row>' for i in range(1, n + 1))
    return zipped({
        "xl/workbook.xml": f'<workbook {S} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="One" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {S}><si><t>name</t></si></sst>", "xl/worksheets/sheet1.xml": f"<worksheet {S}><sheetData>{rows}</sheetData></worksheet>",
    })


def test_documents():
    sections, tables = files.docx_parts(DOCX)
    assert [(s["heading_chain"], s["text"]) for s in sections] == [(["Top"], "one"), (["Top", "Sub"], "two"), (["Next"], "three")] and tables == [[["N", "V"], ["a", "1"]]]
    assert files.xlsx_sheets(xlsx(2)) == [("One", [["name", "", "1"], ["name", "", "2"]])]
    assert files.extract("xlsx", "x", xlsx(200))[1] is None and files.extract("xlsx", "x", xlsx(201)) == ([], "bulk")
    assert files.csv_rows(b"\xef\xbb\xbfa, b\n1,2") == [["a", "b"], ["1", "2"]] and files.csv_rows("é,1".encode("latin-1")) == [["é", "1"]]
    assert files.sheet_chunks("s", [["h", "k"], ["1", "2", "3"], ["4"]]) == ["[s]\nh: 1 | k: 2\nh: 4"]
    assert files.extract("docx", "x", b"no zip")[1].startswith("failed") and files.extract("bin", "x", b"1") == ([], "unsupported")


def test_folder_and_magic(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.docx").write_bytes(DOCX)
    (tmp_path / "b.txt").write_text("hello")
    (tmp_path / "c.pdf").write_bytes(b"<html>")
    table = files.folder(spark, str(tmp_path))
    got = {r.path.rsplit("/", 1)[-1]: r.status for r in files.read_files(table).collect()}
    assert got["a.docx"] == "ok" and got["b.txt"] == "ok" and got["c.pdf"] != "ok"
    from pyspark.sql import functions as F

    kind = F.regexp_extract("path", r"\.(\w+)$", 1)
    fits = {r.path.rsplit("/", 1)[-1]: r.f for r in table.select("path", files.payload_fits(F.col("content"), kind).alias("f")).collect()}
    assert fits == {"a.docx": True, "b.txt": True, "c.pdf": False}


def test_json_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1, "b": "é"}\n\n{"a": oops\n{"a": 2}\n')
    rows, faults = files.json_lines(spark, str(tmp_path / "x.jsonl"), "a int, b string")
    assert sorted((r.a, r.b) for r in rows.collect()) == [(1, "é"), (2, None)] and [r.text for r in faults.collect()] == ['{"a": oops']
    files.write_json_lines(rows, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    assert {r.path: r.url for r in files.url_map(spark, '{"_c": "x", "p/q": "u"}').collect()} == {"p/q": "u"} and files.url_map(spark, "broken").count() == 0


def test_csv_rows_gives_every_supplier(spark, tmp_path):
    spark.createDataFrame([(k, f"Supplier {k}", k % 2) for k in range(1, 901)], "s_suppkey long, s_name string, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    got = [tuple(r) for r in html_queries.csv_rows(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted((f"n{k % 2}.csv", "ok", f"key: {k} | name: Supplier {k}") for k in range(1, 901))
