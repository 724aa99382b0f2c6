"""Reading and writing .xlsx workbooks with the standard library."""

from __future__ import annotations

import datetime as dt
import re
import zipfile
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
EPOCH = dt.datetime(1899, 12, 30)


def column_number(ref: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(ch) - 64
    return n - 1


def column_name(i: int) -> str:
    out = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        out = chr(65 + r) + out
    return out


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    """Numbers of the cell styles that show dates."""
    if "xl/styles.xml" not in z.namelist():
        return set()
    root = ET.fromstring(z.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")) for f in root.iter(f"{NS}numFmt") if re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", "")).lower())}
    dates = own | {*range(14, 23), *range(45, 48)}
    xfs = root.find(f"{NS}cellXfs")
    return {i for i, x in enumerate(xfs if xfs is not None else ()) if int(x.get("numFmtId", 0)) in dates}


def read_rows(path: str, sheet: str | int | None = None) -> Iterator[list[object]]:
    """Rows of a sheet, the first one by default; cells as str, float, bool, datetime or None."""
    with zipfile.ZipFile(path) as z:
        book = ET.fromstring(z.read("xl/workbook.xml"))
        rels = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        sheets = [(s.get("name"), rels[s.get(f"{REL}id")]) for s in book.iter(f"{NS}sheet")]
        if sheet is None:
            target = sheets[0][1]
        elif isinstance(sheet, int):
            target = sheets[sheet][1]
        else:
            found = dict(sheets)
            if sheet not in found:
                raise ValueError(f"no sheet {sheet!r}")
            target = found[sheet]
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{NS}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{NS}si")]
        dates = _date_styles(z)
        with z.open(target.lstrip("/") if target.startswith("/") else f"xl/{target}") as f:
            for _, row in ET.iterparse(f):
                if row.tag != f"{NS}row":
                    continue
                out: list[object] = []
                for c in row.iter(f"{NS}c"):
                    at = column_number(c.get("r")) if c.get("r") else len(out)
                    out += [None] * (at - len(out))
                    out.append(_cell(c, shared, dates))
                yield out
                row.clear()


def _cell(c: ET.Element, shared: list[str], dates: set[int]) -> object:
    kind, v = c.get("t", "n"), c.find(f"{NS}v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in c.iter(f"{NS}t"))
    if v is None or v.text is None:
        return None
    if kind == "s":
        return shared[int(v.text)]
    if kind == "b":
        return v.text == "1"
    if kind in ("str", "e"):
        return v.text
    if int(c.get("s", 0)) in dates:
        return EPOCH + dt.timedelta(days=float(v.text))
    return float(v.text)


def clip(rows: Iterable[list[object]], cells: str | None) -> Iterator[list[object]]:
    """Only the cells of a range like B2:D9."""
    if not cells:
        yield from rows
        return
    m = re.fullmatch(r"([A-Z]+)(\d+):([A-Z]+)(\d+)", cells)
    if not m:
        raise ValueError(f"not a cell range: {cells!r}")
    left, right = column_number(m[1]), column_number(m[3])
    for i, row in enumerate(rows, 1):
        if int(m[2]) <= i <= int(m[4]):
            yield (row + [None] * (right + 1 - len(row)))[left : right + 1]


_FILES = {
    "[Content_Types].xml": '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/></Types>',
    "_rels/.rels": '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/workbook.xml": '<?xml version="1.0"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/styles" Target="styles.xml"/></Relationships>',
    "xl/styles.xml": '<?xml version="1.0"?><styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="22" applyNumberFormat="1"/></cellXfs></styleSheet>',
}


def write_rows(path: str, header: list[str], rows: Iterable[Iterable[object]]) -> None:
    """Stream rows into a new workbook with one sheet; the header comes first."""

    def cell(ref: str, v: object) -> str:
        if v is None:
            return ""
        if isinstance(v, bool):
            return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
        if isinstance(v, dt.datetime):
            return f'<c r="{ref}" s="1"><v>{(v.replace(tzinfo=None) - EPOCH) / dt.timedelta(days=1)!r}</v></c>'
        if isinstance(v, dt.date):
            return f'<c r="{ref}" s="1"><v>{(dt.datetime(v.year, v.month, v.day) - EPOCH).days}</v></c>'
        if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
            return f'<c r="{ref}"><v>{v}</v></c>'
        text = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(v))
        return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'

    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in _FILES.items():
            z.writestr(name, text)
        with z.open("xl/worksheets/sheet1.xml", "w") as f:
            f.write(b'<?xml version="1.0"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>')
            for i, row in enumerate(_with_header(header, rows), 1):
                f.write((f'<row r="{i}">' + "".join(cell(f"{column_name(j)}{i}", v) for j, v in enumerate(row)) + "</row>").encode())
            f.write(b"</sheetData></worksheet>")


def _with_header(header: list[str], rows: Iterable[Iterable[object]]) -> Iterator[Iterable[object]]:
    yield header
    yield from rows
