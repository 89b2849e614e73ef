"""Excel workbooks (.xlsx, .xlsm) as tables, by the standard library alone.

Cells come as they are displayed, as far as their number formats are General, integer, fixed
decimals, thousands, percent or dates; other formats fall back to General. Rows without any cell
are dropped. Legacy .xls files are recognised by name but not read.
"""

from __future__ import annotations

import io
import re
import zipfile
from datetime import datetime, timedelta
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import SparkSession

from ..plans.model import Table
from .tables import headed, table_from_rows

NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Built-in number formats by id.
BUILT_IN = {1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 14: "m/d/yy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy", 20: "h:mm", 21: "h:mm:ss", 22: "m/d/yy h:mm", 37: "#,##0", 38: "#,##0", 39: "#,##0.00", 40: "#,##0.00"}


def is_xlsx_filename(name: str) -> bool:
    return bool(re.search(r"\.(xlsx|xls|xlsm)$", name, re.I))


def _column(reference: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def general(x: float) -> str:
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else f"{x:.10g}"


def _date(serial: float, form: str, epoch_1904: bool) -> str:
    day = datetime(1904, 1, 1) if epoch_1904 else datetime(1899, 12, 30) if serial >= 60 else datetime(1899, 12, 31)
    t = day + timedelta(days=serial)
    out, hours = [], False
    for part in re.findall(r"yyyy|yy|mmmm|mmm|mm|m|dddd|ddd|dd|d|hh|h|ss|s|\"[^\"]*\"|\\.|.", form, re.I):
        p = part.lower()
        if p in ("m", "mm") and hours:
            out.append(f"{t.minute:02d}" if p == "mm" else str(t.minute))
        else:
            out.append({"yyyy": f"{t.year:04d}", "yy": f"{t.year % 100:02d}", "mmmm": f"{t:%B}", "mmm": f"{t:%b}", "mm": f"{t.month:02d}", "m": str(t.month), "dddd": f"{t:%A}", "ddd": f"{t:%a}", "dd": f"{t.day:02d}", "d": str(t.day), "hh": f"{t.hour:02d}", "h": str(t.hour), "ss": f"{t.second:02d}", "s": str(t.second)}.get(p, part.strip('"') if part[0] == '"' else part[-1]))
        hours = p in ("h", "hh") or hours and p == ":"
    return "".join(out)


def displayed(x: float, form: str, epoch_1904: bool = False) -> str:
    """A number under a number format."""
    form = re.sub(r"\[[^\]]*\]", "", form.split(";")[0])
    bare = re.sub(r'"[^"]*"|\\.', "", form)
    if re.search("[ymdhs]", bare, re.I) and "general" not in bare.lower():
        return _date(x, form, epoch_1904)
    if m := re.fullmatch(r"(#,##)?0(\.(0+))?(%)?", bare):
        y = x * 100 if m[4] else x
        return f"{y:{',' if m[1] else ''}.{len(m[3] or '')}f}" + (m[4] or "")
    return general(x)


def sheet_rows(data: bytes, sheet: str | None = None) -> list[list[str]] | None:
    """The displayed cells of a sheet (the first by default); None if there is no such sheet."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        sheets = {s.get("name"): s.get(REL) for s in book.iterfind("m:sheets/m:sheet", NS)}
        if not sheets or sheet is not None and sheet not in sheets:
            return None
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        target = links[sheets[sheet] if sheet else next(iter(sheets.values()))]
        names = set(z.namelist())
        shared = ["".join(t.text or "" for t in s.iter(f"{{{NS['m']}}}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iterfind("m:si", NS)] if "xl/sharedStrings.xml" in names else []
        forms = ["General"]
        if "xl/styles.xml" in names:
            styles = ElementTree.fromstring(z.read("xl/styles.xml"))
            own = {int(f.get("numFmtId")): f.get("formatCode") for f in styles.iterfind("m:numFmts/m:numFmt", NS)}
            forms = [own.get(i) or BUILT_IN.get(i, "General") for i in (int(x.get("numFmtId", "0")) for x in styles.iterfind("m:cellXfs/m:xf", NS))] or forms
        props = book.find("m:workbookPr", NS)
        epoch = props is not None and props.get("date1904") in ("1", "true")
        tree = ElementTree.fromstring(z.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
    rows = []
    for r in tree.iterfind("m:sheetData/m:row", NS):
        row: list[str] = []
        for c in r.iterfind("m:c", NS):
            at = _column(c.get("r")) if c.get("r") else len(row)
            v, kind = c.find("m:v", NS), c.get("t", "n")
            text = v.text if v is not None and v.text is not None else ""
            if kind == "s":
                text = shared[int(text)]
            elif kind == "inlineStr":
                text = "".join(t.text or "" for t in c.iter(f"{{{NS['m']}}}t"))
            elif kind == "b":
                text = "TRUE" if text == "1" else "FALSE"
            elif kind == "n" and text:
                text = displayed(float(text), forms[int(c.get("s", "0"))], epoch)
            row += [""] * (at + 1 - len(row))
            row[at] = text
        if any(row):
            rows.append(row)
    width = max(map(len, rows), default=0)
    return [r + [""] * (width - len(r)) for r in rows]


def parse_xlsx(spark: SparkSession, data: bytes, has_header: bool = True, sheet: str | None = None) -> Table:
    """A workbook's sheet as a table; an unknown sheet is an empty table."""
    headers, body = headed(sheet_rows(data, sheet) or [], has_header)
    return table_from_rows(spark, headers, body)


def read_xlsx(spark: SparkSession, path: str, has_header: bool = True, sheet: str | None = None) -> Table:
    """One workbook from any store that Spark reads."""
    return parse_xlsx(spark, spark.read.format("binaryFile").load(path).first().content, has_header, sheet)


def _cell(value: object, at: str) -> str:
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return f'<c r="{at}"><v>{value}</v></c>'
    return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'


def _letters(i: int) -> str:
    return (_letters(i // 26 - 1) if i >= 26 else "") + chr(65 + i % 26)


def to_xlsx(headers: list[str], rows: list[list], sheet: str = "Sheet1") -> bytes:
    """A workbook of one sheet, for results that are small enough for one."""
    lines = "".join(f'<row r="{i + 1}">' + "".join(_cell(v, f"{_letters(j)}{i + 1}") for j, v in enumerate(r)) + "</row>" for i, r in enumerate([headers, *rows]))
    main, rel = NS["m"], REL[1:].split("}")[0]
    package = "http://schemas.openxmlformats.org/package/2006"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    files = {
        "[Content_Types].xml": f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><sheetData>{lines}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()
