"""Workbooks in the Office Open XML format, by the standard library: reading one sheet, writing several."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _column(ref: str) -> int:
    n = 0
    for ch in re.match("[A-Z]+", ref)[0]:
        n = 26 * n + ord(ch) - 64
    return n - 1


def sheets(raw: bytes) -> dict[str, list[list[str | None]]]:
    """Sheet name -> rows of cells as text."""
    book = zipfile.ZipFile(io.BytesIO(raw))
    shared: list[str] = []
    if "xl/sharedStrings.xml" in book.namelist():
        for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si"):
            shared.append("".join(t.text or "" for t in item.iter(f"{_MAIN}t")))
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    out = {}
    for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
        target = targets[sheet.get(f"{_REL}id")].lstrip("/")
        rows: list[list[str | None]] = []
        for row in ElementTree.fromstring(book.read(target if target.startswith("xl/") else f"xl/{target}")).iter(f"{_MAIN}row"):
            cells: list[str | None] = []
            for k, c in enumerate(row.iter(f"{_MAIN}c")):
                at = _column(c.get("r")) if c.get("r") else k
                cells += [None] * (at + 1 - len(cells))
                v = c.find(f"{_MAIN}v")
                if c.get("t") == "s" and v is not None:
                    cells[at] = shared[int(v.text)]
                elif c.get("t") == "inlineStr":
                    cells[at] = "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
                elif v is not None:
                    cells[at] = v.text
            rows.append(cells)
        out[sheet.get("name")] = rows
    return out


def read_workbook(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """One sheet with a header as string columns: the named one, or else the one with most cells, the first on ties."""
    raw = bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    found = sheets(raw)
    name = sheet if sheet in found else max(found, key=lambda n: (max(0, len(found[n]) - 1) * max(1, max(map(len, found[n]), default=0)), -list(found).index(n)))
    rows = found[name]
    if not rows:
        raise ValueError(f"sheet {name} is empty")
    names: list[str] = []
    keep = []
    for i, n in enumerate(rows[0]):
        n = n or f"col_{i + 1}"
        if n not in names:
            names.append(n)
            keep.append(i)
    schema = ", ".join(f"`{n.replace('`', '')}` string" for n in names)
    return spark.createDataFrame([tuple(r[i] if i < len(r) else None for i in keep) for r in rows[1:]], schema)


def workbook(tables: dict[str, tuple[list[str], list[tuple]]]) -> bytes:
    """The bytes of a workbook from sheet name -> (columns, rows)."""
    out = io.BytesIO()
    names = list(tables)
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        types = "".join(f'<Override PartName="/xl/worksheets/sheet{i + 1}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(len(names)))
        z.writestr("[Content_Types].xml", f'<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{types}</Types>')
        z.writestr("_rels/.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        listed = "".join(f'<sheet name="{escape(n[:31], {chr(34): "&quot;"})}" sheetId="{i + 1}" r:id="rId{i + 1}"/>' for i, n in enumerate(names))
        z.writestr("xl/workbook.xml", f'<?xml version="1.0"?><workbook xmlns="{_MAIN[1:-1]}" xmlns:r="{_REL[1:-1]}"><sheets>{listed}</sheets></workbook>')
        rels = "".join(f'<Relationship Id="rId{i + 1}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{i + 1}.xml"/>' for i in range(len(names)))
        z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rels}</Relationships>')
        for i, n in enumerate(names):
            columns, rows = tables[n]
            body = []
            for row in [tuple(columns), *rows]:
                cells = []
                for v in row:
                    if v is None or v != v:
                        cells.append("<c/>")
                    elif isinstance(v, int | float) and not isinstance(v, bool):
                        cells.append(f"<c><v>{v}</v></c>")
                    else:
                        clean = re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(v))[:32767]
                        cells.append(f'<c t="inlineStr"><is><t xml:space="preserve">{escape(clean)}</t></is></c>')
                body.append(f"<row>{''.join(cells)}</row>")
            z.writestr(f"xl/worksheets/sheet{i + 1}.xml", f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_MAIN[1:-1]}"><sheetData>{"".join(body)}</sheetData></worksheet>')
    return out.getvalue()
