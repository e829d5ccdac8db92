"""Workbooks (.xlsx): every sheet as a table of text, and a plain writer for bounded results."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.operators.order import written_once
from tabloom.operators.relational import OperatorError

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}
MAX_ROWS = 300_000


def _column(ref: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(ch) - 64
    return n - 1


def _letters(i: int) -> str:
    out = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        out = chr(65 + r) + out
    return out


def sheets(data: bytes) -> dict[str, list[list[str | None]]]:
    """Sheet name -> rows of cell texts. A workbook is bounded by its format, so it is parsed whole."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS):
                shared.append("".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")))
        rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = {}
        for s in ElementTree.fromstring(z.read("xl/workbook.xml")).find("m:sheets", _NS):
            target = rels[s.get(f"{{{_NS['r']}}}id")].lstrip("/")
            rows = []
            for row in ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")).iter(f"{{{_NS['m']}}}row"):
                cells: list[str | None] = []
                for c in row.findall("m:c", _NS):
                    at = _column(c.get("r")) if c.get("r") else len(cells)
                    cells += [None] * (at + 1 - len(cells))
                    v = c.find("m:v", _NS)
                    if c.get("t") == "inlineStr":
                        cells[at] = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t"))
                    elif v is not None:
                        cells[at] = shared[int(v.text)] if c.get("t") == "s" else v.text
                rows.append(cells)
            out[s.get("name")] = rows
    return out


def read_workbook(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables by sheet, all text; the first row is the header, names are made unique. Rows arise where the file is parsed, on an executor."""
    files = spark.read.format("binaryFile").load(path).select("content")
    if files.select(F.lit(1)).limit(2).count() != 1:
        raise OperatorError("one workbook at a time")

    def parse(frames):
        for frame in frames:
            for content in frame["content"]:
                for k, (name, rows) in enumerate(sheets(content).items()):
                    yield pd.DataFrame({"place": k, "sheet": name, "at": range(len(rows)), "cells": rows})

    cells = written_once(files.mapInPandas(parse, "place int, sheet string, at int, cells array<string>"))
    widths = {r.sheet: r.width for r in cells.groupBy("place", "sheet").agg(F.max(F.size("cells")).alias("width")).orderBy("place").collect()}  # a row for each sheet
    heads = {r.sheet: r.cells for r in cells.where("at = 0").collect()}
    out = {}
    for name, width in widths.items():
        head, seen = [], set()
        for i in range(width):
            base = (heads[name][i] if i < len(heads[name]) and heads[name][i] else f"column_{i + 1}").strip()
            n, k = base, 2
            while n.lower() in seen:
                n, k = f"{base}_{k}", k + 1
            seen.add(n.lower())
            head.append(n)
        out[name] = cells.where((F.col("sheet") == name) & (F.col("at") > 0)).select(*[F.get("cells", F.lit(i)).alias(h) for i, h in enumerate(head)])
    return out


def write_workbook(path: str, tables: dict[str, DataFrame], max_rows: int = MAX_ROWS) -> None:
    """Bounded results as sheets of a new workbook; more rows than max_rows are refused, not cut."""
    parts = {}
    used: set[str] = set()
    for name, df in tables.items():
        rows = df.limit(max_rows + 1).collect()
        if len(rows) > max_rows:
            raise OperatorError(f"{name} has more than {max_rows} rows")
        base = re.sub(r"[\[\]:*?/\\]", "_", name)[:31] or "Sheet"
        safe, k = base, 2
        while safe.lower() in used:
            safe, k = f"{base[: 30 - len(str(k))]}_{k}", k + 1
        used.add(safe.lower())
        lines = []
        for i, r in enumerate([df.columns, *rows], 1):
            cells = []
            for j, v in enumerate(r):
                ref = f"{_letters(j)}{i}"
                if isinstance(v, bool) or v is None or not isinstance(v, (int, float)) or v != v:
                    text = "" if v is None else str(v)
                    text = "'" + text if re.match(r"[ \t\r\n]*[=+\-@]", text) else text
                    text = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", text)
                    cells.append(f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>' if v is not None else "")
                else:
                    cells.append(f'<c r="{ref}"><v>{v!r}</v></c>')
            lines.append(f'<row r="{i}">{"".join(cells)}</row>')
        parts[safe] = f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_NS["m"]}"><sheetData>{"".join(lines)}</sheetData></worksheet>'
    n = range(1, len(parts) + 1)
    kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in n)
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    with zipfile.ZipFile(path, "x", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'<?xml version="1.0" encoding="UTF-8"?><Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
        z.writestr("_rels/.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="{_NS["m"]}" xmlns:r="{office}"><sheets>{"".join(f"""<sheet name="{escape(s, {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>""" for i, s in zip(n, parts))}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{package}/relationships">{"".join(f"""<Relationship Id="rId{i}" Type="{office}/worksheet" Target="worksheets/sheet{i}.xml"/>""" for i in n)}</Relationships>')
        for i, body in zip(n, parts.values()):
            z.writestr(f"xl/worksheets/sheet{i}.xml", body)
