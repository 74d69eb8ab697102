"""DOCX as a sink: a text as a new document, or put into a template. Results are a binary column, for any writer."""

from __future__ import annotations

import copy
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..operators.diff import fill_template

_NS = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_W = f"{{{_NS}}}"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
#: Patterns of headings with their level, in order (the second with the longest line it holds for), and points of a level.
HEADINGS_ZH = ((r"^第[一二三四五六七八九十]+[章节条]", 1), (r"^[零一二三四五六七八九十]+、", 2), (r"(?U)^\d+[.．].{0,27}$", 2), (r"[：:]$", 2), (r"^【[^】]+】$", 2))
POINTS = {0: 12, 1: 18, 2: 16, 3: 14}


def heading_level(line: Column) -> Column:
    """1 to 3, or 0 for ordinary text; short lines with a few digits are of level 3."""
    n, digits = F.length(line), F.length(F.regexp_replace(line, r"(?U)[^\d]", ""))
    out = F.when(F.lit(False), 0)
    for pattern, level in HEADINGS_ZH:
        out = out.when(line.rlike(pattern), level)
    return out.when((n < 20) & (n > 2) & (digits > 0) & (digits < n * 0.3), 3).otherwise(0)


def _paragraph(text: str, level: int) -> str:
    style = f'<w:pPr><w:outlineLvl w:val="{level - 1}"/></w:pPr>' if level else '<w:pPr><w:jc w:val="both"/></w:pPr>'
    run = f'<w:r><w:rPr>{"<w:b/>" if level else ""}<w:sz w:val="{2 * POINTS[level]}"/></w:rPr><w:t xml:space="preserve">{escape(text)}</w:t></w:r>' if text else ""
    return f"<w:p>{style}{run}</w:p>"


def docx_bytes(lines: list[tuple[str, int]], title: str | None = None) -> bytes:
    """A document of lines (text, level); title stands in the header."""
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    office = "application/vnd.openxmlformats-officedocument.wordprocessingml"
    section = '<w:sectPr><w:headerReference w:type="default" r:id="rId1"/></w:sectPr>' if title else ""
    parts = {
        "[Content_Types].xml": f'{head}<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
        f'<Override PartName="/word/document.xml" ContentType="{office}.document.main+xml"/>' + (f'<Override PartName="/word/header1.xml" ContentType="{office}.header+xml"/>' if title else "") + "</Types>",
        "_rels/.rels": f'{head}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="word/document.xml"/></Relationships>',
        "word/document.xml": f'{head}<w:document xmlns:w="{_NS}" xmlns:r="{_REL}"><w:body>{"".join(_paragraph(t, n) for t, n in lines)}{section}</w:body></w:document>',
    }
    if title:
        parts["word/header1.xml"] = f'{head}<w:hdr xmlns:w="{_NS}">{_paragraph(title, 0)}</w:hdr>'
        parts["word/_rels/document.xml.rels"] = f'{head}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_REL}/header" Target="header1.xml"/></Relationships>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            z.writestr(zipfile.ZipInfo(name), body)
    return out.getvalue()


#: What a line starts with that opens a table block.
TABLE_MARKS = ("【表格】", "[表格]")
#: A table block: lines with tabs in front of it (the same cells as a reader shows them), the mark, and lines with bars.
_BLOCK = re.compile(
    r"(?:^[^\n]*\t[^\n]*\n)*(?:^[^\S\n]*\n)*^[^\S\n]*(?:" + "|".join(map(re.escape, TABLE_MARKS)) + r")[^\n]*(?P<rows>(?:\n[^\S\n]*(?:$|[^\n|]*\|[^\n]*))*)", re.MULTILINE
)


def table_blocks(text: str) -> tuple[str, list[list[list[str]]]]:
    """text without its table blocks, and the cells of those that have two rows or more, all of one width."""
    tables = []
    for block in _BLOCK.finditer(text):
        rows = [[c.strip() for c in line.split("|")] for line in block["rows"].split("\n") if line.strip()]
        if len(rows) > 1 and len({len(r) for r in rows}) == 1:
            tables.append(rows)
    return _BLOCK.sub("", text), tables


def _say(parent, value: str) -> None:
    """value as the text of a paragraph or cell, in the format that it has; a cell's other paragraphs are emptied."""
    places = list(parent.iter(f"{_W}t"))
    if not places:
        if not value:
            return
        home = parent if parent.tag == f"{_W}p" else next(parent.iter(f"{_W}p"), None)
        home = ElementTree.SubElement(parent, f"{_W}p") if home is None else home
        run = next(home.iter(f"{_W}r"), None)
        places = [ElementTree.SubElement(ElementTree.SubElement(home, f"{_W}r") if run is None else run, f"{_W}t")]
    for t in places[1:]:
        t.text = ""
    places[0].text = value


def _fill_table(table, rows: list[list[str]]) -> None:
    """A template's table with these cells: rows are added in the last one's format, cells without a value are emptied."""
    lines = table.findall(f"{_W}tr")
    while lines and len(lines) < len(rows):
        lines.append(copy.deepcopy(lines[-1]))
        table.append(lines[-1])
    for i, line in enumerate(lines):
        for k, cell in enumerate(line.findall(f"{_W}tc")):
            _say(cell, rows[i][k] if i < len(rows) and k < len(rows[i]) else "")


def _table(rows: list[list[str]]) -> str:
    cell = lambda x, bold: f'<w:tc><w:p><w:r><w:rPr>{"<w:b/>" if bold else ""}</w:rPr><w:t xml:space="preserve">{escape(x)}</w:t></w:r></w:p></w:tc>'
    lines = "".join(f"<w:tr>{''.join(cell(x, i == 0) for x in row)}</w:tr>" for i, row in enumerate(rows))
    grid = "".join("<w:gridCol/>" for _ in rows[0])
    return f'<w:tbl><w:tblPr><w:tblStyle w:val="TableGrid"/></w:tblPr><w:tblGrid>{grid}</w:tblGrid>{lines}</w:tbl>'


def filled(template: bytes, text: str) -> bytes:
    """The template with its body's paragraphs replaced, cleared or appended to, as fill_template aligns them; formats stay.

    Table blocks of the text go into the template's tables one by one; further ones come last, as new tables.
    """
    text, tables = table_blocks(text)
    with zipfile.ZipFile(io.BytesIO(template)) as z:
        parts = {i.filename: z.read(i) for i in z.infolist()}
    root = ElementTree.fromstring(parts["word/document.xml"])
    body = root.find(f"{_W}body")
    said = lambda p: "".join(t.text or "" for t in p.iter(f"{_W}t")).strip()
    old = [p for p in body.findall(f"{_W}p") if said(p)]
    new = [x.strip() for x in text.split("\n") if x.strip()]

    def append(xml: str) -> None:
        made = ElementTree.fromstring(f'<w:x xmlns:w="{_NS}">{xml}</w:x>')[0]
        last = body.find(f"{_W}sectPr")
        body.insert(len(body) if last is None else list(body).index(last), made)

    own = body.findall(f"{_W}tbl")
    for action, i, k in fill_template([said(p) for p in old], new):
        if action == "append":
            append(_paragraph(new[k], 0))
        else:
            _say(old[i], new[k] if action == "replace" else "")
    for table, rows in zip(own, tables, strict=False):
        _fill_table(table, rows)
    for rows in tables[len(own) :]:
        append(_table(rows))
    parts["word/document.xml"] = ElementTree.tostring(root, encoding="utf-8", xml_declaration=True)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, part in parts.items():
            z.writestr(zipfile.ZipInfo(name), part)
    return out.getvalue()


def with_docx(docs: DataFrame, text_col: str = "text", title: Column | None = None, out_col: str = "docx") -> DataFrame:
    """docs with their text as a document; a null text is an empty one."""
    lines = F.transform(F.split(F.coalesce(text_col, F.lit("")), "\n"), lambda x: F.struct(strip(x).alias("text"), heading_level(strip(x)).alias("level")))

    @F.pandas_udf("binary")
    def made(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for many, titles in batches:
            yield pd.Series([docx_bytes([(x["text"], x["level"]) for x in one], t) for one, t in zip(many, titles, strict=True)])

    return docs.withColumn(out_col, made(lines, F.lit(None).cast("string") if title is None else title))


def with_filled(docs: DataFrame, template_col: str, text_col: str = "text", out_col: str = "docx") -> DataFrame:
    """docs with text_col put into the template of the same row; null if either is."""

    @F.pandas_udf("binary")
    def made(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for templates, texts in batches:
            yield pd.Series([None if t is None or x is None else filled(bytes(t), x) for t, x in zip(templates, texts, strict=True)], dtype=object)

    return docs.withColumn(out_col, made(template_col, text_col))
