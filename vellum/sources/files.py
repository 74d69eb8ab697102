"""Files of documents and rules as DataFrames, and results as files."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip

#: The largest file that is taken, and the kinds.
MAX_BYTES, KINDS = 10 << 20, ("docx", "pdf", "txt")
#: Fixed value: the line above a table's rows in parsed text.
TABLE_MARK = "[表格]"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def decode(raw: bytes) -> str:
    """UTF-8, else GBK."""
    try:
        return raw.decode("utf-8-sig")
    except UnicodeDecodeError:
        return raw.decode("gbk", "replace")


def docx_text(raw: bytes) -> str:
    """Paragraphs and tables in the order of the body; a table is a mark and its rows, cells between bars."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    of = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t")).strip()
    lines = []
    for e in body if body is not None else ():
        if e.tag == f"{_W}p":
            lines.append(of(e))
        elif e.tag == f"{_W}tbl":
            rows = [" | ".join(of(c) for c in r.findall(f"{_W}tc")) for r in e.findall(f"{_W}tr")]
            lines += [TABLE_MARK, *rows] if any(rows) else []
    return "\n".join(x for x in lines if x)


def pdf_text(raw: bytes) -> str:
    raise ValueError("no PDF reader is installed; pass pdf=")


def read_documents(spark: SparkSession, path: str, pdf=pdf_text) -> DataFrame:
    """path, kind, text, error of the files under path: by extension, non-empty, of MAX_BYTES at most.

    Sizes and names are tested before any content is read; one bad file is an error in its row, not a failure.
    """
    files = spark.read.format("binaryFile").load(path)
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    problem = F.when(~kind.isin(*KINDS), "unsupported kind").when(F.col("length") == 0, "empty file").when(F.col("length") > MAX_BYTES, "too large")
    rows = files.select("path", kind.alias("kind"), problem.alias("error"), F.when(problem.isNull(), F.col("content")).alias("content"))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        readers = {"txt": decode, "docx": docx_text, "pdf": pdf}
        for batch in batches:
            texts, errors = [], []
            for k, error, raw in zip(batch.kind, batch.error, batch.content, strict=True):
                text = None
                if error is None:
                    try:
                        text = readers[k](bytes(raw))
                    except Exception as e:  # noqa: BLE001  a damaged file is a row with an error
                        error = f"{type(e).__name__}: {e}"[:200]
                texts.append(text)
                errors.append(error)
            yield pd.DataFrame({"path": batch.path, "kind": batch.kind, "text": texts, "error": errors})

    return rows.mapInPandas(parse, "path string, kind string, text string, error string")


def _whole_files(spark: SparkSession, path: str, parse, schema: str) -> DataFrame:
    """Rows that parse(text) gives of each file under path, as files of MAX_BYTES at most are read whole, one in each row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, raw in zip(batch.path, batch.content, strict=True):
                if len(raw) > MAX_BYTES:
                    raise ValueError(f"{name}: too large")
                rows = parse(decode(bytes(raw)))
                yield pd.DataFrame([(name, *r) for r in rows], columns=[f.split()[0] for f in schema.split(", ")])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


def read_rules_csv(spark: SparkSession, path: str, headers: dict[str, str], default_perspective: str | None = None) -> DataFrame:
    """A rule file (UTF-8 or GBK) with its header names mapped, and each row's number in its file, the header's being 1.

    A missing header is an error unless it is the perspective's and has a default; blank rows are left out.
    """

    def parse(text: str):
        lines = csv.reader(io.StringIO(text.lstrip("\ufeff"), newline=""))
        names = [h.strip() for h in next(lines, [])]
        yield (0, names, [])
        yield from ((i, names, [c.strip() for c in row]) for i, row in enumerate(lines, 2) if any(c.strip() for c in row))

    rows = _whole_files(spark, path, parse, "path string, row_number long, names array<string>, cells array<string>")
    for name, found in {r["path"]: r["names"] for r in rows.where("row_number = 0").select("path", "names").collect()}.items():
        lacking = [h for h, n in headers.items() if h not in found and not (n == "review_perspective" and default_perspective)]
        if lacking:
            raise ValueError(f"{name}: missing headers: " + ", ".join(lacking))
    at = lambda h: F.coalesce(F.get("cells", F.nullif(F.array_position("names", F.lit(h)).cast("int"), F.lit(0)) - 1), F.when(F.array_contains("names", F.lit(h)), ""))
    cols = [(F.coalesce(at(h), F.lit(default_perspective)) if n == "review_perspective" else at(h)).alias(n) for h, n in headers.items()]
    return rows.where("row_number > 0").select(*cols, "row_number")


def read_cases(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files of JSON lines as (path, line_number, row, error); blank lines are skipped, a malformed one has its number and no row."""
    parse = lambda text: ((i, line) for i, line in enumerate(text.split("\n"), 1) if line.strip())
    lines = _whole_files(spark, path, parse, "path string, line_number long, line string")
    read = F.from_json("line", schema, {"mode": "PERMISSIVE"})
    bad = F.try_parse_json("line").isNull() | ~F.trim("line").startswith("{")
    return lines.select("path", "line_number", F.when(~bad, read).alias("row"), F.when(bad, F.concat(F.lit("line "), F.col("line_number").cast("string"), F.lit(" is no JSON object"))).alias("error"))


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType, strict: bool = True) -> DataFrame:
    """Lines of JSON, blank ones skipped. strict: a malformed line fails the read, else it has a null row and its text."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", schema).alias("row"), F.col("value").alias("line"))


# --- lenient JSON ---------------------------------------------------------------------------------


def json_slice(text: Column) -> Column:
    """The JSON in a model's answer: without thoughts and code fence, else its outermost braces or brackets."""
    t = F.trim(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""))
    fenced = F.regexp_extract(t, r"(?si)```(?:json)?\s*(.*?)\s*```", 1)
    t = F.when(fenced != "", fenced).otherwise(t)
    whole = lambda c: F.try_parse_json(c).isNotNull()
    braces, brackets = F.regexp_extract(t, r"(?s)\{.*\}", 0), F.regexp_extract(t, r"(?s)\[.*\]", 0)
    return F.when(whole(t), t).when((braces != "") & whole(braces), braces).when((brackets != "") & whole(brackets), brackets)


def unwrapped(text: Column, schema: str) -> Column:
    """from_json of the slice; JSON that is a string of JSON is read once more."""
    first = json_slice(text)
    inner = F.from_json(F.concat(F.lit('{"v":'), first, F.lit("}")), "v string")["v"]
    return F.when(F.startswith(first, F.lit('"')), F.from_json(json_slice(inner), schema)).otherwise(F.from_json(first, schema))


def rules_in(text: Column, item: str) -> Column:
    """Array of the rules in a model's answer, whether it is a list of them, an object that has them under `rules`, or one rule."""
    found = json_slice(text)
    under = F.get_json_object(found, "$.rules")
    many = f"array<{item}>"
    return F.when(F.startswith(found, F.lit("[")), F.from_json(found, many)).when(F.startswith(under, F.lit("[")), F.from_json(under, many)).when(found.isNotNull(), F.array(F.from_json(found, item)))


# --- sinks ----------------------------------------------------------------------------------------


def export_csv(df: DataFrame, path: str, columns: list[str], one_file: bool = False) -> None:
    """CSV with a fixed column order and a byte-order mark in each part's first header, for spreadsheets.

    one_file puts all rows through one task; it is for what a person opens.
    """
    first = F.col(columns[0]).alias("﻿" + columns[0])
    out = df.select(first, *columns[1:])
    (out.coalesce(1) if one_file else out).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def table_rows(text: Column) -> Column:
    """Cells of a table block (mark, then rows with bars): array of arrays; null if rows differ in width."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    rows = F.transform(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(1))), lambda r: F.transform(F.split(r, r"\|"), lambda c: F.trim(c)))
    ragged = F.exists(rows, lambda r: F.size(r) != F.size(F.get(rows, F.lit(0))))
    return F.when((F.trim(F.get(lines, F.lit(0))) == TABLE_MARK) & (F.size(lines) > 1) & ~ragged, rows)


def table_block(rows: Column) -> Column:
    """The block that table_rows reads: the mark, then rows with bars between their cells."""
    lines = F.transform(rows, lambda r: F.array_join(r, " | ", ""))
    return F.when(F.size(rows) > 0, F.concat_ws("\n", F.lit(TABLE_MARK), F.array_join(lines, "\n")))
