import os
import zipfile

from tablescope.operators.clean import clean_table
from tablescope.sources.delimited import inspect_sources
from tablescope.sources.workbooks import read_workbooks, sheet_names

CT = """<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"/>"""
WB = """<?xml version="1.0"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"
 xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>
 <sheet name="Billing Summary" sheetId="1" r:id="rId1"/><sheet name="Other" sheetId="2" r:id="rId2"/></sheets></workbook>"""
RELS = """<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">
 <Relationship Id="rId1" Type="ws" Target="worksheets/sheet1.xml"/>
 <Relationship Id="rId2" Type="ws" Target="worksheets/sheet2.xml"/></Relationships>"""
STYLES = """<?xml version="1.0"?><styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">
 <cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>"""
SHARED = ["CITY HOSPITAL - INPATIENT BILLING REPORT", "Date", "Bill Number", "Amount", "Grand Total"]


def _cell(ref, value, kind=None, style=None):
    s = f' s="{style}"' if style is not None else ""
    if kind == "inline":
        return f'<c r="{ref}" t="inlineStr"{s}><is><t>{value}</t></is></c>'
    t = f' t="{kind}"' if kind else ""
    return f'<c r="{ref}"{t}{s}><v>{value}</v></c>'


def _sheet(rows):
    body = "".join(f'<row r="{i}">{"".join(cells)}</row>' for i, cells in rows)
    return ('<?xml version="1.0"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">'
            f"<sheetData>{body}</sheetData></worksheet>")


def _workbook(path):
    rows = [(1, [_cell("A1", 0, "s")]), (3, [_cell("A3", 1, "s"), _cell("B3", 2, "s"), _cell("C3", 3, "s")])]
    for d in range(1, 11):
        r = 3 + d
        rows.append((r, [_cell(f"A{r}", 45291 + d, style=1), _cell(f"B{r}", f"INV-{1000 + d}", "inline"),
                         _cell(f"C{r}", f" ${112.5 * d:,.2f} ", "inline")]))
    rows.append((14, [_cell("A14", 4, "s"), _cell("C14", 9999)]))
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("[Content_Types].xml", CT)
        z.writestr("xl/workbook.xml", WB)
        z.writestr("xl/_rels/workbook.xml.rels", RELS)
        z.writestr("xl/styles.xml", STYLES)
        sst = "".join(f"<si><t>{s}</t></si>" for s in SHARED)
        z.writestr("xl/sharedStrings.xml",
                   f'<?xml version="1.0"?><sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">{sst}</sst>')
        z.writestr("xl/worksheets/sheet1.xml", _sheet(rows))
        z.writestr("xl/worksheets/sheet2.xml", _sheet([(1, [_cell("A1", 1)])]))


def test_read_workbook_and_clean(spark, tmp_dir):
    p = os.path.join(tmp_dir, "bill.xlsx")
    _workbook(p)
    names = [(r["sheet_index"], r["sheet"]) for r in sheet_names(spark, p).orderBy("sheet_index").collect()]
    assert names == [(0, "Billing Summary"), (1, "Other")]
    out = clean_table(read_workbooks(spark, p))
    assert out.columns == ["Date", "Bill Number", "Amount"]
    assert dict(out.dtypes)["Amount"] == "double" and dict(out.dtypes)["Date"] == "timestamp"
    rows = out.orderBy("Date").collect()
    assert len(rows) == 10 and rows[0]["Amount"] == 112.5 and str(rows[0]["Date"]) == "2024-01-01 00:00:00"


def test_inspect_sources(spark, tmp_dir):
    _workbook(os.path.join(tmp_dir, "good.xlsx"))
    with open(os.path.join(tmp_dir, "bad.xlsx"), "wb") as fh:
        fh.write(b"not a zip")
    open(os.path.join(tmp_dir, "empty.csv"), "wb").close()
    with open(os.path.join(tmp_dir, "ok.csv"), "w") as fh:
        fh.write("a,b\n1,2\n")
    with open(os.path.join(tmp_dir, "notes.txt"), "w") as fh:
        fh.write("x")
    got = {os.path.basename(r["path"]): (r["status"], r["reason"]) for r in inspect_sources(spark, tmp_dir).collect()}
    assert got["good.xlsx"] == ("ok", None) and got["ok.csv"] == ("ok", None)
    assert got["bad.xlsx"] == ("rejected", "Missing ZIP header")
    assert got["empty.csv"] == ("rejected", "The file is empty")
    assert got["notes.txt"] == ("rejected", "Unsupported file format")


def test_every_workbook_has_a_status(spark, tmp_dir):
    from tablescope.sources.workbooks import workbook_status
    _workbook(os.path.join(tmp_dir, "good.xlsx"))
    with open(os.path.join(tmp_dir, "bad.xlsx"), "wb") as fh:
        fh.write(b"not a zip")
    got = {os.path.basename(r["path"]): r for r in workbook_status(spark, tmp_dir).collect()}
    assert got["good.xlsx"]["status"] == "ok" and got["good.xlsx"]["rows"] > 0
    assert got["bad.xlsx"]["reason"] == "Unreadable workbook: BadZipFile" and got["bad.xlsx"]["rows"] == 0
    named = {os.path.basename(r["path"]): r["reason"] for r in workbook_status(spark, tmp_dir, sheet="absent").collect()}
    assert named["good.xlsx"] == "No sheet named absent"
