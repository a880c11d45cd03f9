"""Workbooks: a reader that makes cell tables and grids, a writer, and appending in place."""

from __future__ import annotations

import datetime as dt
import io
import re
import sys
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# The reader goes to the executors by value, so these need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Numbers of the built-in formats that show dates or times.
_DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
_EPOCH = dt.datetime(1899, 12, 30)


def column_letters(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def column_number(letters: str) -> int:
    n = 0
    for c in letters.upper():
        n = n * 26 + ord(c) - 64
    return n


@dataclass
class Sheet:
    name: str
    cells: dict[tuple[int, int], Any] = field(default_factory=dict)
    merges: list[str] = field(default_factory=list)
    part: str = ""

    @property
    def max_row(self) -> int:
        return max((r for r, _ in self.cells), default=1)

    @property
    def max_column(self) -> int:
        return max((c for _, c in self.cells), default=1)

    @property
    def dimensions(self) -> str:
        low_r, low_c = min((r for r, _ in self.cells), default=1), min((c for _, c in self.cells), default=1)
        return f"{column_letters(low_c)}{low_r}:{column_letters(self.max_column)}{self.max_row}"

    def value(self, row: int, column: int) -> Any:
        return self.cells.get((row, column))


def cell_kind(value: Any) -> str:
    """The kind of a cell's value; booleans aren't integers here."""
    for kind, classes in (
        ("boolean", bool), ("integer", int), ("float", float), ("date", (dt.date, dt.datetime)), ("string", str)
    ):
        if isinstance(value, classes):
            return kind
    return "empty" if value is None else "other"


def _is_date_format(code: str) -> bool:
    return bool(re.search("[dmyhs]", re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", code.lower())))


def _value(cell: ET.Element, shared: list[str], dates: set[int]) -> Any:
    kind, raw = cell.get("t", "n"), cell.findtext(f"{_NS}v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{_NS}t")) or None
    if raw is None or raw == "":
        return None
    if kind == "s":
        return shared[int(raw)] or None
    if kind in ("str", "e"):
        return raw
    if kind == "b":
        return raw == "1"
    if kind == "d":
        return dt.datetime.fromisoformat(raw)
    number = float(raw) if re.search("[.eE]", raw) else int(raw)
    return _EPOCH + dt.timedelta(days=number + (number < 60)) if int(cell.get("s", 0)) in dates else number


def read_workbook(source: str | bytes) -> list[Sheet]:
    """All sheets in order. Formulas give their stored values, empty text is no value."""
    with zipfile.ZipFile(io.BytesIO(source) if isinstance(source, bytes) else source) as z:
        names = set(z.namelist())
        shared = [
            "".join(t.text or "" for t in si.iter(f"{_NS}t"))
            for si in ET.fromstring(z.read("xl/sharedStrings.xml"))
        ] if "xl/sharedStrings.xml" in names else []
        dates: set[int] = set()
        if "xl/styles.xml" in names:
            styles = ET.fromstring(z.read("xl/styles.xml"))
            own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in styles.iter(f"{_NS}numFmt")}
            for i, xf in enumerate(styles.findall(f"{_NS}cellXfs/{_NS}xf")):
                n = int(xf.get("numFmtId", 0))
                if n in _DATE_FORMATS or n in own and _is_date_format(own[n]):
                    dates.add(i)
        targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        sheets = []
        for s in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{_NS}sheet"):
            target = targets[s.get(_REL)]
            part = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            sheet, root = Sheet(s.get("name"), part=part), ET.fromstring(z.read(part))
            for r, row in enumerate(root.iter(f"{_NS}row"), 1):
                number, column = int(row.get("r", r)), 0
                for cell in row.iter(f"{_NS}c"):
                    at = re.match(r"([A-Z]+)(\d+)", cell.get("r", ""))
                    column = column_number(at[1]) if at else column + 1
                    sheet.cells[number, column] = _value(cell, shared, dates)
            sheet.merges = sorted(m.get("ref") for m in root.iter(f"{_NS}mergeCell"))
            sheets.append(sheet)
    return sheets


def text_of(value: Any) -> str | None:
    """The text that a cell has in a grid: Python's, and ISO for dates."""
    return None if value is None else value.isoformat(sep=" ") if isinstance(value, dt.datetime) else str(value)


def grid(spark: SparkSession, sheet: Sheet) -> DataFrame:
    """The raw grid: _c0, _c1, ... as text, and _src_row from 1. A sheet has at most 2**20 rows."""
    n, width = sheet.max_row, sheet.max_column
    rows = [
        (*[text_of(sheet.value(r, c)) for c in range(1, width + 1)], r)
        for r in range(1, n + 1)
    ] if sheet.cells else []
    schema = T.StructType(
        [*[T.StructField(f"_c{i}", T.StringType()) for i in range(width)], T.StructField("_src_row", T.IntegerType())]
    )
    return spark.createDataFrame(rows, schema)


CELLS = "sheet string, sheet_index int, _src_row int, col int, kind string, text string"


def cell_table(spark: SparkSession, sheets: list[Sheet]) -> DataFrame:
    """A row for each cell that has a value."""
    return spark.createDataFrame(
        [
            (s.name, i, r, c, cell_kind(v), text_of(v))
            for i, s in enumerate(sheets)
            for (r, c), v in sorted(s.cells.items())
            if v is not None
        ],
        CELLS
    )


def workbook_cells(spark: SparkSession, path: str) -> DataFrame:
    """``cell_table`` of all workbooks at ``path``, with the file's path; each file is parsed by a task of its own.

    A file that is no workbook is an error. No files give no rows.
    """
    schema = pa.schema(
        [
            ("path", pa.string()), ("sheet", pa.string()), ("sheet_index", pa.int32()), ("_src_row", pa.int32()),
            ("col", pa.int32()), ("kind", pa.string()), ("text", pa.string())
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                for i, sheet in enumerate(read_workbook(data.as_py())):
                    cells = [
                        (name, sheet.name, i, r, c, cell_kind(v), text_of(v))
                        for (r, c), v in sorted(sheet.cells.items())
                        if v is not None
                    ]
                    for a in range(0, len(cells), 10_000):
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(x, f.type)
                                for x, f in zip(zip(*cells[a : a + 10_000], strict=True), schema, strict=True)
                            ],
                            schema=schema
                        )

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, f"path string, {CELLS}")


def _cell_xml(row: int, column: int, value: Any) -> str:
    ref = f"{column_letters(column)}{row}"
    if value is None:
        return ""
    if isinstance(value, bool):
        return f'<c r="{ref}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        return f'<c r="{ref}"><v>{value!r}</v></c>'
    text = value.isoformat() if isinstance(value, (dt.date, dt.datetime)) else str(value)
    return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


_MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def write_workbook(path: str, sheets: dict[str, list[list[Any]]], merges: dict[str, list[str]] | None = None) -> None:
    """A plain workbook from rows of values."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        put = lambda name, text: z.writestr(
            zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)),
            '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + text
        )
        kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        put(
            "[Content_Types].xml",
            '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>' + f'<Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>' + "".join(
                f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>'
                for i in range(1, len(sheets) + 1)
            ) + "</Types>"
        )
        rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        package = 'xmlns="http://schemas.openxmlformats.org/package/2006/relationships"'
        put(
            "_rels/.rels",
            f'<Relationships {package}><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>'
        )
        put(
            "xl/workbook.xml",
            f'<workbook {_MAIN} xmlns:r="{rel}"><sheets>' + "".join(
                f'<sheet name="{escape(n)}" sheetId="{i}" r:id="rId{i}"/>'
                for i, n in enumerate(sheets, 1)
            ) + "</sheets></workbook>"
        )
        put(
            "xl/_rels/workbook.xml.rels",
            f"<Relationships {package}>" + "".join(
                f'<Relationship Id="rId{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>'
                for i in range(1, len(sheets) + 1)
            ) + "</Relationships>"
        )
        for i, (name, rows) in enumerate(sheets.items(), 1):
            body = "".join(
                f'<row r="{r}">{"".join(_cell_xml(r, c, v) for c, v in enumerate(row, 1))}</row>'
                for r, row in enumerate(rows, 1)
            )
            merged = "".join(f'<mergeCell ref="{m}"/>' for m in (merges or {}).get(name, []))
            put(
                f"xl/worksheets/sheet{i}.xml",
                f"<worksheet {_MAIN}><sheetData>{body}</sheetData>" + (
                    f"<mergeCells>{merged}</mergeCells>" if merged else ""
                ) + "</worksheet>"
            )


def append_rows(path: str, sheet: Sheet, start_row: int, start_column: int, rows: list[list[Any]]) -> None:
    """Puts rows into a sheet of a workbook; every other part of the file keeps its bytes.

    Rows that exist below, for cells outside the columns, take the new cells in.
    """
    with zipfile.ZipFile(path) as z:
        parts = [(i, z.read(i)) for i in z.infolist()]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for info, data in parts:
            if info.filename == sheet.part:
                text = data.decode()
                for k, row in enumerate(rows):
                    text = _with_row(text, start_row + k, start_column, row)
                data = text.encode()
            z.writestr(info, data)
    with open(path, "wb") as f:
        f.write(out.getvalue())


def _with_row(text: str, number: int, first: int, values: list[Any]) -> str:
    new = {first + i: _cell_xml(number, first + i, v) for i, v in enumerate(values)}
    found = re.search(rf'<row\b[^>]*\br="{number}"[^>]*?(/>|>(.*?)</row>)', text, re.S)
    if found:
        old = {
            column_number(m[1]): m[0]
            for m in re.finditer(r'<c\b[^>]*\br="([A-Z]+)\d+"[^>]*?(?:/>|>.*?</c>)', found[2] or "", re.S)
        }
        head = re.match(r"<row\b[^>]*?(?=/?>)", found[0])[0]
        return text[: found.start()] + f"{head}>{''.join(x for _, x in sorted((old | new).items()))}</row>" + text[found.end() :]
    row = f'<row r="{number}">{"".join(x for _, x in sorted(new.items()))}</row>'
    after = next((m.start() for m in re.finditer(r'<row\b[^>]*\br="(\d+)"', text) if int(m[1]) > number), None)
    if after is None:
        text = re.sub(r"<sheetData\s*/>", "<sheetData></sheetData>", text)
        after = text.index("</sheetData>")
    return text[:after] + row + text[after:]
