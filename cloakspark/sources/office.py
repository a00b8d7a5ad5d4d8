"""Readers and writers of office files with nothing but the standard library: both formats are zip archives of XML.

Files come through Spark's `binaryFile` source and are taken apart in the tasks; one file is one row until then.
"""

from __future__ import annotations

import io
import os
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _column(reference: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def read_workbook(data: bytes) -> dict[str, list[list[str | None]]]:
    """Rows of cell texts of each sheet, in the workbook's order; numbers as they are stored, null for empty cells."""
    return {name: [[c and c[0] for c in row] for row in rows] for name, rows in _typed_cells(data).items()}


def _typed_cells(data: bytes) -> dict[str, list[list[tuple[str, str] | None]]]:
    """The same with what a cell is, besides its text: `number`, `boolean` or `text`."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_S}si")]
        targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = {}
        for sheet in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet"):
            target = targets[sheet.get(f"{_R}id")].lstrip("/")
            part = target if target.startswith("xl/") else f"xl/{target}"
            rows: list[list[tuple[str, str] | None]] = []
            for row in ET.fromstring(z.read(part)).iter(f"{_S}row"):
                number = int(row.get("r") or len(rows) + 1)
                rows += [[] for _ in range(number - 1 - len(rows))]
                cells: list[tuple[str, str] | None] = []
                for c in row.iter(f"{_S}c"):
                    at = _column(c.get("r")) if c.get("r") else len(cells)
                    cells += [None] * (at + 1 - len(cells))
                    kind, v = c.get("t"), c.find(f"{_S}v")
                    if kind == "inlineStr":
                        cells[at] = "".join(t.text or "" for t in c.iter(f"{_S}t")), "text"
                    elif v is not None and v.text is not None:
                        cells[at] = (shared[int(v.text)], "text") if kind == "s" else ("TRUE" if v.text == "1" else "FALSE", "boolean") if kind == "b" else (v.text, "number" if kind in (None, "n") else "text")
                rows.append(cells)
            out[sheet.get("name")] = rows
    return out


def write_workbook(sheets: dict[str, tuple[list[str], list[list]]], shaded: set[tuple[int, int]] | None = None) -> bytes:
    """A workbook of (header, rows) by sheet; headers bold, cells (row, column) of the first sheet in `shaded` yellow."""
    def cell(value: object, r: int, c: int, style: int) -> str:
        letters, n = "", c + 1
        while n:
            n, rest = divmod(n - 1, 26)
            letters = chr(65 + rest) + letters
        place = f'r="{letters}{r}"' + (f' s="{style}"' if style else "")
        if value is None:
            return f"<c {place}/>"
        if isinstance(value, (int, float)) and not isinstance(value, bool):
            return f"<c {place}><v>{value}</v></c>"
        return f'<c {place} t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        ids = range(1, len(sheets) + 1)
        z.writestr("[Content_Types].xml", '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in ids) + "</Types>")
        z.writestr("_rels/.rels", '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="{_S[1:-1]}" xmlns:r="{_R[1:-1]}"><sheets>' + "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, n in zip(ids, sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in ids) + f'<Relationship Id="rId{len(sheets) + 1}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/styles" Target="styles.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<?xml version="1.0" encoding="UTF-8"?><styleSheet xmlns="{_S[1:-1]}"><fonts count="2"><font/><font><b/></font></fonts><fills count="3"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill><fill><patternFill patternType="solid"><fgColor rgb="FFFFFF00"/></patternFill></fill></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="3"><xf/><xf fontId="1" applyFont="1"/><xf fillId="2" applyFill="1"/></cellXfs></styleSheet>')
        for i, (header, rows) in zip(ids, sheets.values()):
            lines = ["".join(cell(h, 1, c, 1) for c, h in enumerate(header))]
            lines += ["".join(cell(v, r + 2, c, 2 if i == 1 and (r, c) in (shaded or ()) else 0) for c, v in enumerate(row)) for r, row in enumerate(rows)]
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_S[1:-1]}"><sheetData>' + "".join(f'<row r="{r}">{line}</row>' for r, line in enumerate(lines, 1)) + "</sheetData></worksheet>")
    return out.getvalue()


def _paragraph_nodes(z: zipfile.ZipFile) -> Iterator[tuple[str, ET.Element, ET.Element]]:
    """(part, tree, paragraph): the body's own paragraphs, then those of its tables, then headers and footers once per part."""
    body_part = "word/document.xml"
    tree = ET.fromstring(z.read(body_part))
    body = tree.find(f"{_W}body")
    if body is not None:
        yield from ((body_part, tree, p) for p in body.findall(f"{_W}p"))
        for t in body.findall(f"{_W}tbl"):
            yield from ((body_part, tree, p) for p in t.iter(f"{_W}p"))
    for part in sorted(n for n in z.namelist() if re.fullmatch(r"word/(?:header|footer)\d*\.xml", n)):
        tree = ET.fromstring(z.read(part))
        yield from ((part, tree, p) for p in tree.iter(f"{_W}p"))


def _run_text(run: ET.Element) -> str:
    out = ""
    for x in run:
        out += (x.text or "") if x.tag == f"{_W}t" else "\t" if x.tag == f"{_W}tab" else "\n" if x.tag in (f"{_W}br", f"{_W}cr") else ""
    return out


def read_blocks(data: bytes) -> list[list[str]]:
    """The run texts of each paragraph, paragraphs in a stable order."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return [[_run_text(r) for r in p.findall(f"{_W}r")] for _, _, p in _paragraph_nodes(z)]


def write_blocks(data: bytes, runs: dict[int, dict[int, str]]) -> bytes:
    """The document with run texts replaced, by paragraph and run; runs that aren't named keep text and format."""
    out, trees = io.BytesIO(), {}
    with zipfile.ZipFile(io.BytesIO(data)) as z, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as to:
        for n, (part, tree, p) in enumerate(_paragraph_nodes(z)):
            trees[part] = tree
            for k, r in enumerate(p.findall(f"{_W}r")):
                if k in runs.get(n, {}):
                    for x in [x for x in r if x.tag in (f"{_W}t", f"{_W}tab", f"{_W}br", f"{_W}cr")]:
                        r.remove(x)
                    t = ET.SubElement(r, f"{_W}t", {"{http://www.w3.org/XML/1998/namespace}space": "preserve"})
                    t.text = runs[n][k]
        for name in z.namelist():
            to.writestr(name, ET.tostring(trees[name], encoding="UTF-8", xml_declaration=True) if name in trees else z.read(name))
    return out.getvalue()


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def sheet_cells(spark: SparkSession, path: str, first_only: bool = True) -> DataFrame:
    """`path, sheet, sheet_ord, row_id, header, cells, kinds` of the workbooks under a path; the first row of a sheet is its header.

    A sheet of a header alone has one row without `row_id`, so that its columns aren't lost. `kinds` says of each cell
    whether it is a number, a boolean or text.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for n, (name, rows) in enumerate(_typed_cells(data).items()):
                    if rows and not (first_only and n):
                        part = lambda row, k: [c and c[k] for c in row]
                        body = rows[1:] or [[]]
                        texts, ids = pa.list_(pa.string()), list(range(len(body))) if rows[1:] else [None]
                        yield pa.RecordBatch.from_arrays([pa.array([p] * len(body)), pa.array([name] * len(body), pa.string()), pa.array([n] * len(body), pa.int32()), pa.array(ids, pa.int64()), pa.array([part(rows[0], 0)] * len(body), texts), pa.array([part(r, 0) for r in body], texts), pa.array([part(r, 1) for r in body], texts)], ["path", "sheet", "sheet_ord", "row_id", "header", "cells", "kinds"])

    return _files(spark, path).mapInArrow(run, "path string, sheet string, sheet_ord int, row_id long, header array<string>, cells array<string>, kinds array<string>")


def read_sheet(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """One sheet of one workbook (the first, or by name) as a table with `row_id`.

    A column whose cells are all numbers is one of whole numbers or, if any has a fraction, of doubles; one of booleans
    is boolean; any other, an empty one too, is a string. A sheet of a header alone is a table without rows.
    """
    cells = sheet_cells(spark, path, first_only=sheet is None)
    if sheet is not None:
        cells = cells.where(cells["sheet"] == sheet)
    first = cells.select("header").limit(1).collect()
    header = [h for h in (first[0][0] if first else [])]
    at = lambda c, n: F.get(F.col(c), n)
    rows = cells.where("row_id is not null")
    kept = [(n, h) for n, h in enumerate(header) if h]
    kinds = F.struct(*(F.struct(F.collect_set(at("kinds", n)).alias("kinds"), F.coalesce(F.bool_and(at("cells", n).rlike("^-?[0-9]{1,18}$")), F.lit(False)).alias("whole")).alias(str(n)) for n, _ in kept))
    seen = rows.agg(kinds.alias("k")).first()["k"] if kept else {}
    type_of = lambda k: {("number",): "long" if k["whole"] else "double", ("boolean",): "boolean"}.get(tuple(k["kinds"]), "string")
    return rows.select("row_id", *(at("cells", n).cast(type_of(seen[str(n)])).alias(h) for n, h in kept))


def block_units(spark: SparkSession, path: str) -> DataFrame:
    """`path, unit_idx, text, runs` of the text documents under a path."""
    kind = pa.list_(pa.struct([("run_idx", pa.int32()), ("start", pa.int32()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                blocks = read_blocks(data)
                runs = [[{"run_idx": k, "start": sum(map(len, r[:k])), "text": t} for k, t in enumerate(r)] for r in blocks]
                yield pa.RecordBatch.from_arrays([pa.array([p] * len(blocks), pa.string()), pa.array(range(len(blocks)), pa.int32()), pa.array(["".join(r) for r in blocks], pa.string()), pa.array(runs, kind)], ["path", "unit_idx", "text", "runs"])

    return _files(spark, path).mapInArrow(run, "path string, unit_idx int, text string, runs array<struct<run_idx:int,start:int,text:string>>")


#: Rows of data that a sheet holds below its header.
MAX_SHEET_ROWS = (1 << 20) - 1


def _sheet_rows(df: DataFrame) -> list:
    rows = df.limit(MAX_SHEET_ROWS + 1).collect()
    if len(rows) > MAX_SHEET_ROWS:
        raise ValueError("too many rows for a workbook; write a table instead")
    return rows


def save_redacted_workbook(redacted: DataFrame, crosswalk: DataFrame, path: str) -> None:
    """One workbook with the sheets `Redacted` and `Crosswalk`, for results of a size a workbook can hold (`MAX_SHEET_ROWS` each)."""
    rows, listed = _sheet_rows(redacted), _sheet_rows(crosswalk)
    columns = [c for c in redacted.columns if c != "changed"]
    shaded = {(r, columns.index(c)) for r, row in enumerate(rows) for c in (row["changed"] if "changed" in redacted.columns else ()) if c in columns}
    data = write_workbook({"Redacted": (columns, [[row[c] for c in columns] for row in rows]), "Crosswalk": (crosswalk.columns, [list(r) for r in listed])}, shaded)
    with open(path, "wb") as f:
        f.write(data)


def save_crosswalk(crosswalk: DataFrame, path: str) -> None:
    """The crosswalk as CSV with a header. It re-identifies people: give it a place of its own."""
    crosswalk.write.mode("overwrite").option("header", True).csv(path)


class CachedList:
    """The rows of a workbook's sheets, read again only when the file has changed; the old rows are let go of then."""

    def __init__(self, spark: SparkSession, path: str, parse):
        self.spark, self.path, self.parse, self.stamp, self.held = spark, path, parse, None, None

    def rows(self) -> DataFrame:
        stamp = os.stat(self.path).st_mtime_ns
        if stamp != self.stamp:
            if self.held is not None:
                self.held.unpersist()
            names = [r[0] for r in sheet_cells(self.spark, self.path, first_only=False).select("sheet").distinct().collect()]
            self.held = self.parse({n: read_sheet(self.spark, self.path, n) for n in names}).cache()
            self.stamp = stamp
        return self.held
