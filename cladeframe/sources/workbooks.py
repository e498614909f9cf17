"""XLSX and DOCX from their XML, with the standard library alone.

A workbook is one binary file and is decoded where it lies: ``binaryFile`` rows through
``mapInPandas``. The writer is for reports, whose size a reader can look through.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def sheets(raw: bytes) -> Iterator[tuple[str, list[list[str]]]]:
    """(name, rows of text) in the workbook's order; shared and inline strings are resolved, missing cells are blank."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = set(z.namelist())
        shared = [] if "xl/sharedStrings.xml" not in names else ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_S}si")]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet"):
            target = targets[sheet.get(f"{_R}id")].lstrip("/")
            tree = ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
            rows = []
            for row in tree.iter(f"{_S}row"):
                cells: dict[int, str] = {}
                for k, c in enumerate(row.iter(f"{_S}c")):
                    kind, value = c.get("t"), c.find(f"{_S}v")
                    said = "".join(t.text or "" for t in c.iter(f"{_S}t")) if kind == "inlineStr" else "" if value is None else shared[int(value.text)] if kind == "s" else value.text or ""
                    cells[_column(c.get("r")) if c.get("r") else k] = said
                rows.append([cells.get(k, "") for k in range(max(cells, default=-1) + 1)])
            yield sheet.get("name"), rows


def read_workbook(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """path, sheet, ordinal, cells (header to text): the first non-blank row of a sheet is its header."""

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, raw in zip(frame["path"], frame["content"], strict=True):
                out = []
                for name, rows in sheets(bytes(raw)):
                    filled = [r for r in rows if any(x.strip() for x in r)]
                    if filled:
                        head = [h.strip() for h in filled[0]]
                        out += [(path, name, k, dict(zip(head, [*r, *[""] * (len(head) - len(r))], strict=False))) for k, r in enumerate(filled[1:])]
                yield pd.DataFrame(out, columns=["path", "sheet", "ordinal", "cells"])

    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    return files.mapInPandas(decode, "path string, sheet string, ordinal int, cells map<string,string>")


def workbook_bytes(tables: dict[str, tuple[list[str], list[list]]]) -> bytes:
    """A workbook of plain sheets: name to (header, rows)."""
    out = io.BytesIO()
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'

    def cell(v) -> str:
        if v is None or v == "":
            return "<c/>"
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return f"<c><v>{v!r}</v></c>"
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in range(1, len(tables) + 1))
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{_R[1:-1]}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{_S[1:-1]}" xmlns:r="{_R[1:-1]}"><sheets>' + "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{k}" r:id="r{k}"/>' for k, n in enumerate(tables, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{k}" Type="{_R[1:-1]}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(tables) + 1)) + "</Relationships>")
        for k, (columns, rows) in enumerate(tables.values(), 1):
            body = "".join(f"<row>{''.join(map(cell, r))}</row>" for r in [columns, *rows])
            z.writestr(f"xl/worksheets/sheet{k}.xml", f'{head}<worksheet xmlns="{_S[1:-1]}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


SHEET_ROWS = 1_048_575  # below the head; the format holds no more
SHEETS = 255


def write_workbook(sheets: dict[str, DataFrame], path: str) -> None:
    """One workbook of small tables, on any file system that Spark writes to. More rows or sheets than the format holds are an error."""
    if len(sheets) > SHEETS:
        raise ValueError(f"more than {SHEETS} sheets")
    told = {}
    for name, rows in sheets.items():
        found = rows.limit(SHEET_ROWS + 1).collect()
        if len(found) > SHEET_ROWS:
            raise ValueError(f"more than {SHEET_ROWS} rows in sheet {name}")
        told[name] = rows.columns, [list(r) for r in found]
    spark = next(iter(sheets.values())).sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    out.write(workbook_bytes(told))
    out.close()


def write_tabs(rows: DataFrame, by: str, path: str, order: Sequence[str] = (), more: dict[str, DataFrame] | None = None) -> None:
    """One sheet a value of ``by``, in its order, after the sheets of ``more`` (counts, exclusions)."""
    values = [r[0] for r in rows.select(by).distinct().orderBy(by).limit(SHEETS + 1).collect()]
    own = {str(v): rows.filter(rows[by].eqNullSafe(v)).drop(by) for v in values}
    write_workbook((more or {}) | {k: v.orderBy(*order) if order else v for k, v in own.items()}, path)


def document_pages(raw: bytes) -> list[str]:
    """A DOCX file's paragraphs, parted where page breaks stand."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        tree = ElementTree.fromstring(z.read("word/document.xml"))
    pages: list[list[str]] = [[]]
    for p in tree.iter(f"{_W}p"):
        pages[-1].append("".join(t.text or "" for t in p.iter(f"{_W}t")))
        if any(b.get(f"{_W}type") == "page" for b in p.iter(f"{_W}br")):
            pages.append([])
    return ["\n".join(x).strip() for x in pages]


def read_documents(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """path, page, text of DOCX and XLSX files (a sheet is a page, cells are parted by ' | ')."""

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path, raw in zip(frame["path"], frame["content"], strict=True):
                texts = document_pages(bytes(raw)) if path.lower().endswith(".docx") else [f"{n}\n" + "\n".join(" | ".join(r) for r in rows) for n, rows in sheets(bytes(raw))]
                out += [(path, k, t) for k, t in enumerate(texts, 1)]
            yield pd.DataFrame(out, columns=["path", "page", "text"])

    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    return files.mapInPandas(decode, "path string, page int, text string")
