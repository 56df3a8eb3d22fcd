""".xlsx workbooks read in parallel, one file per task.

``binaryFile`` hands each workbook (bounded by the upload cap) to a
``mapInPandas`` function that opens the ZIP with the standard library and
streams the sheet XML; cells come out as text, a sheet as raw-grid rows.
Legacy .xls (BIFF) is not decoded.
"""
from __future__ import annotations

import datetime as _dt
import io
import re
import zipfile
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main",
      "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships",
      "rel": "http://schemas.openxmlformats.org/package/2006/relationships"}
# fixed values: built-in number formats that show dates
DATE_FORMAT_IDS = set(range(14, 23)) | set(range(45, 48))
EXCEL_EPOCH = _dt.datetime(1899, 12, 30)
ROW_SCHEMA = "_file string, sheet string, _row_ord bigint, cells array<string>"
SHEET_SCHEMA = "_file string, sheet_index int, sheet string"


def _col_index(ref: str) -> int:
    letters = re.match(r"[A-Z]+", ref).group(0)
    n = 0
    for ch in letters:
        n = n * 26 + (ord(ch) - 64)
    return n - 1


def _sheets(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    wb = ET.fromstring(z.read("xl/workbook.xml"))
    rels = ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))
    target = {r.get("Id"): r.get("Target") for r in rels.findall("rel:Relationship", NS)}
    out = []
    for s in wb.findall("m:sheets/m:sheet", NS):
        rid = s.get(f"{{{NS['r']}}}id")
        t = target.get(rid, "")
        t = t.lstrip("/")
        out.append((s.get("name"), t if t.startswith("xl/") else f"xl/{t}"))
    return out


def _shared_strings(z: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in z.namelist():
        return []
    root = ET.fromstring(z.read("xl/sharedStrings.xml"))
    return ["".join(t.text or "" for t in si.iter(f"{{{NS['m']}}}t")) for si in root.findall("m:si", NS)]


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in z.namelist():
        return set()
    root = ET.fromstring(z.read("xl/styles.xml"))
    custom = {}
    for nf in root.findall("m:numFmts/m:numFmt", NS):
        code = (nf.get("formatCode") or "").lower()
        custom[int(nf.get("numFmtId"))] = bool(re.search(r"[dmyhs]", re.sub(r'"[^"]*"', "", code)))
    out = set()
    for i, xf in enumerate(root.findall("m:cellXfs/m:xf", NS)):
        fid = int(xf.get("numFmtId", 0))
        if fid in DATE_FORMAT_IDS or custom.get(fid):
            out.add(i)
    return out


def _num_text(raw: str) -> str:
    f = float(raw)
    return str(int(f)) if f.is_integer() and "." not in raw and "E" not in raw.upper() else repr(f)


def _date_text(raw: str) -> str:
    t = EXCEL_EPOCH + _dt.timedelta(days=float(raw))
    t = t.replace(microsecond=0) if t.microsecond < 500 or t.microsecond > 999_500 else t
    return t.strftime("%Y-%m-%d %H:%M:%S")


def _sheet_rows(z, path, shared, dates):
    root_iter = ET.iterparse(io.BytesIO(z.read(path)), events=("end",))
    for _, el in root_iter:
        if el.tag != f"{{{NS['m']}}}row":
            continue
        cells: dict[int, str | None] = {}
        for c in el.findall("m:c", NS):
            idx = _col_index(c.get("r"))
            typ = c.get("t")
            v = c.find("m:v", NS)
            if typ == "inlineStr":
                val = "".join(t.text or "" for t in c.iter(f"{{{NS['m']}}}t"))
            elif v is None or v.text is None:
                val = None
            elif typ == "s":
                val = shared[int(v.text)]
            elif typ in ("str", "e"):
                val = v.text
            elif typ == "b":
                val = "True" if v.text == "1" else "False"
            elif int(c.get("s", 0)) in dates:
                val = _date_text(v.text)
            else:
                val = _num_text(v.text)
            cells[idx] = val
        yield int(el.get("r")) - 1, cells
        el.clear()


def _read(batches, sheet: str | None):
    for pdf in batches:
        out = []
        for path, content in zip(pdf["path"], pdf["content"]):
            try:
                z = zipfile.ZipFile(io.BytesIO(bytes(content)))
                names = _sheets(z)
                chosen = [n for n in names if n[0] == sheet] if sheet else names[:1]
                if not chosen:
                    continue
                shared, dates = _shared_strings(z), _date_styles(z)
                name, target = chosen[0]
                for r, (_, cells) in enumerate(_sheet_rows(z, target, shared, dates)):
                    width = (max(cells) + 1) if cells else 0
                    row = [cells.get(i) for i in range(width)]
                    row = [None if (x is None or x == "") else x for x in row]
                    out.append((path, name, r, row))
            except (zipfile.BadZipFile, KeyError, ET.ParseError):
                continue
        yield pd.DataFrame(out, columns=["_file", "sheet", "_row_ord", "cells"])


def _sheet_names(batches):
    for pdf in batches:
        out = []
        for path, content in zip(pdf["path"], pdf["content"]):
            try:
                z = zipfile.ZipFile(io.BytesIO(bytes(content)))
                out += [(path, i, n) for i, (n, _) in enumerate(_sheets(z))]
            except (zipfile.BadZipFile, KeyError, ET.ParseError):
                continue
        yield pd.DataFrame(out, columns=["_file", "sheet_index", "sheet"])


def _statuses(batches, sheet: str | None):
    for pdf in batches:
        out = []
        for path, content in zip(pdf["path"], pdf["content"]):
            try:
                z = zipfile.ZipFile(io.BytesIO(bytes(content)))
                names = _sheets(z)
                chosen = [n for n in names if n[0] == sheet] if sheet else names[:1]
                if not chosen:
                    out.append((path, "rejected", f"No sheet named {sheet}" if sheet else "No sheet", 0))
                    continue
                shared, dates = _shared_strings(z), _date_styles(z)
                out.append((path, "ok", None, sum(1 for _ in _sheet_rows(z, chosen[0][1], shared, dates))))
            except (zipfile.BadZipFile, KeyError, ET.ParseError) as e:
                out.append((path, "rejected", f"Unreadable workbook: {type(e).__name__}", 0))
        yield pd.DataFrame(out, columns=["path", "status", "reason", "rows"])


def _binary(spark: SparkSession, paths, max_bytes: int | None):
    from ..session import ship_package
    ship_package(spark)
    files = spark.read.format("binaryFile").load(paths)
    # a cap holds only where the caller asks for one; ``inspect_sources`` reports what it leaves out
    return (files if max_bytes is None else files.where(F.col("length") <= max_bytes)).select("path", "content")


def workbook_rows(spark: SparkSession, paths, sheet: str | None = None, max_bytes: int | None = None) -> DataFrame:
    """``(_file, sheet, _row_ord, cells)``: one row per sheet row of each workbook."""
    return _binary(spark, paths, max_bytes).mapInPandas(lambda it: _read(it, sheet), ROW_SCHEMA)


def sheet_names(spark: SparkSession, paths, max_bytes: int | None = None) -> DataFrame:
    """``(_file, sheet_index, sheet)`` for every workbook."""
    return _binary(spark, paths, max_bytes).mapInPandas(_sheet_names, SHEET_SCHEMA)


def workbook_status(spark: SparkSession, paths, sheet: str | None = None, max_bytes: int | None = None) -> DataFrame:
    """One row per workbook, ``(path, status, reason, rows)``: whether its first (or named) sheet can be read, else why not."""
    return _binary(spark, paths, max_bytes).mapInPandas(lambda it: _statuses(it, sheet), "path string, status string, reason string, rows long")


def read_workbooks(spark: SparkSession, paths, sheet: str | None = None, width: int | None = None,
                   max_bytes: int | None = None) -> DataFrame:
    """The first (or named) sheet of every workbook as a raw grid
    ``(_file, _row_ord, c0 … cN)``; spreadsheet error cells → NULL."""
    from ..functions.constants import EXCEL_ERRORS
    rows = workbook_rows(spark, paths, sheet, max_bytes)
    if width is None:
        width = rows.agg(F.max(F.size("cells"))).first()[0] or 1
    grid = rows.select("_file", F.struct(F.lit(0).cast("bigint").alias("block"),
                                         F.col("_row_ord").alias("row")).alias("_row_ord"),
                       *[F.try_element_at("cells", F.lit(i + 1)).alias(f"c{i}") for i in range(width)])
    from ..operators.clean import na_to_null
    return na_to_null(grid, EXCEL_ERRORS)
