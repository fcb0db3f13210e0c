"""Documents from files: text, CSV, DOCX and XLSX without other libraries; PDF where one is installed. JSON lines with their faults.

Readers take the bytes that Spark's binaryFile source gives, in Arrow batches; what a payload is follows from its first bytes.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.chunking import ROWS_LEAST, ROWS_MOST, group

#: Rows of a workbook, all sheets together, above which it is raw data and gives nothing.
MOST_ROWS = 200
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def payload_fits(content: Column, kind: Column) -> Column:
    """Whether bytes are what their kind says: %PDF- within the first KB, the ZIP or OLE signature, and for others no HTML."""
    head = F.substring(content, 1, 1024)
    text = F.hex(head)
    html = F.ltrim(F.decode(head, "ISO-8859-1")).startswith("<")
    return (
        F.when(kind == "pdf", F.instr(text, "255044462D") > 0).when(kind.isin("docx", "xlsx", "xlsm"), text.startswith("504B0304"))
        .when(kind.isin("doc", "xls"), text.startswith("D0CF11E0A1B11AE1")).otherwise((F.length(content) > 0) & ~html)
    )


def csv_rows(data: bytes) -> list[list[str]]:
    """The rows of a CSV file in UTF-8 (with or without BOM), else Latin-1; cells without white space around; a broken file has none."""
    try:
        text = data.decode("utf-8-sig")
    except UnicodeDecodeError:
        text = data.decode("latin-1")
    try:
        return [[c.strip() for c in row] for row in csv.reader(io.StringIO(text, newline=""), strict=True)]
    except csv.Error:
        return []


def xlsx_sheets(data: bytes) -> list[tuple[str, list[list[str]]]]:
    """The sheets of a workbook with the values of their cells."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_S}si")]
        parts = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet"):
            target = parts[sheet.get(f"{_R}id")].lstrip("/")
            rows = []
            for row in ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")).iter(f"{_S}row"):
                cells: dict[int, str] = {}
                for n, c in enumerate(row.iter(f"{_S}c")):
                    place = re.match(r"[A-Z]+", c.get("r", ""))
                    column = sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(place[0]))) - 1 if place else n
                    v = c.find(f"{_S}v")
                    text = "".join(t.text or "" for t in c.iter(f"{_S}t")) if c.get("t") == "inlineStr" else (v.text or "") if v is not None else ""
                    cells[column] = (shared[int(text)] if c.get("t") == "s" and text else text).strip()
                rows.append([cells.get(k, "") for k in range(max(cells, default=-1) + 1)])
            out.append((sheet.get("name", ""), rows))
    return out


def docx_parts(data: bytes) -> tuple[list[dict], list[list[list[str]]]]:
    """(sections, tables): sections with the chain of headings above them and their text, tables as rows of cells."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    text_of = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t")).strip()
    chain: list[tuple[int, str]] = []
    sections: list[dict] = []
    open_lines: list[str] = []

    def close() -> None:
        if open_lines:
            sections.append({"heading_chain": [h for _, h in chain], "text": "\n".join(open_lines)})
            open_lines.clear()

    tables = []
    for e in body if body is not None else ():
        if e.tag == f"{_W}tbl":
            tables.append([[text_of(c) for c in r.iter(f"{_W}tc")] for r in e.iter(f"{_W}tr")])
        elif e.tag == f"{_W}p" and (text := text_of(e)):
            style = e.find(f"{_W}pPr/{_W}pStyle")
            m = re.match(r"(?i)heading ?(\d)|(title)$", style.get(f"{_W}val", "")) if style is not None else None
            if m:
                close()
                level = int(m[1] or 0)
                chain[:] = [x for x in chain if x[0] < level] + [(level, text)]
            else:
                open_lines.append(text)
    close()
    return sections, [t for t in tables if len(t) > 1]


def sheet_chunks(name: str, rows: list[list[str]]) -> list[str]:
    """Groups of rendered rows under `[sheet]`. The first row is a header if one of its first two cells is filled; a row and its header are cut to the shorter."""
    rows = [r for r in rows if any(r)]
    if not rows:
        return []
    header = rows[0] if any(rows[0][:2]) and len(rows) > 1 else None
    shown = []
    for r in rows[1:] if header else rows:
        pairs = zip(header, r) if header else (("", v) for v in r)
        line = " | ".join(f"{h}: {v}" if h else v for h, v in pairs if v)
        if line:
            shown.append(line)
    return [f"[{name}]\n" + "\n".join(shown[a:b]) for a, b in group([len(s) for s in shown], ROWS_LEAST, ROWS_MOST)]


def extract(kind: str, name: str, data: bytes | None) -> tuple[list[dict], str | None]:
    """(pieces, reason): pieces of text with the headings above them, or why there are none."""
    if not data:
        return [], "empty"
    try:
        if kind == "txt":
            text = data.decode("utf-8", "replace").strip()
            return ([{"heading_chain": [], "text": text}], None) if text else ([], "empty")
        if kind == "docx":
            sections, tables = docx_parts(data)
            rows = [{"heading_chain": [], "text": t} for table in tables for t in sheet_chunks("table", table)]
            return (sections + rows, None) if sections or rows else ([], "empty")
        if kind in ("csv", "xlsx", "xlsm"):
            sheets = [(name, csv_rows(data))] if kind == "csv" else xlsx_sheets(data)
            if sum(len(r) for _, r in sheets) > MOST_ROWS:
                return [], "bulk"
            pieces = [{"heading_chain": [], "text": t} for n, r in sheets for t in sheet_chunks(n, r)]
            return (pieces, None) if pieces else ([], "empty")
        if kind == "pdf":
            try:
                import pypdf
            except ImportError:
                return [], "no PDF library"
            text = "\n\n".join(p.extract_text() or "" for p in pypdf.PdfReader(io.BytesIO(data)).pages)
            return ([{"heading_chain": [], "text": text}], None) if len(re.findall(r"\w", text)) >= 20 else ([], "needs OCR")
    except Exception as x:
        return [], f"failed: {type(x).__name__}"
    return [], "unsupported"


def read_files(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, kind, status, reason, pieces) of files as binaryFile gives them; one failing file fails alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = pa.list_(pa.struct([("heading_chain", pa.list_(pa.string())), ("text", pa.string())]))
        for batch in batches:
            rows = []
            for p, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                file = re.split(r"[?#]", p or "")[0].rsplit("/", 1)[-1]
                kind = file.rsplit(".", 1)[-1].lower() if "." in file else ""
                pieces, reason = extract(kind, file, data)
                rows.append((kind, "ok" if pieces else "failed" if (reason or "").startswith("failed") else "empty", reason, pieces))
            c = list(zip(*rows)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(c[0], pa.string()), pa.array(c[1], pa.string()), pa.array(c[2], pa.string()), pa.array(c[3], piece)], ["path", "kind", "status", "reason", "pieces"])

    return files.select(path, content).mapInArrow(run, "path string, kind string, status string, reason string, pieces array<struct<heading_chain:array<string>,text:string>>")


def folder(spark: SparkSession, path: str) -> DataFrame:
    """All files below a folder, as binaryFile rows."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, faults) of JSON lines: blank lines are skipped, a line that doesn't parse is a fault (file, text) and no row."""
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), "value").filter(F.trim("value") != "")
    parsed = lines.withColumn("r", F.from_json("value", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    good = parsed.filter(F.col("r._corrupt_record").isNull()).select("r.*").drop("_corrupt_record")
    return good, parsed.filter(F.col("r._corrupt_record").isNotNull()).select("file", F.col("value").alias("text"))


def write_json_lines(rows: DataFrame, path: str) -> None:
    """UTF-8 JSON lines; the committer publishes a finished job only."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def url_map(spark: SparkSession, text: str) -> DataFrame:
    """(path, url) of a JSON object; keys that start with an underscore are comments, a broken object has no rows."""
    one = spark.createDataFrame([(text,)], "t string").select(F.from_json("t", "map<string,string>").alias("m"))
    return one.select(F.explode(F.map_filter("m", lambda k, v: ~k.startswith("_"))).alias("path", "url"))
