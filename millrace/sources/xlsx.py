"""XLSX workbooks as cell tables: opening, editing, querying by A1 ranges, and saving."""

from __future__ import annotations

import io
import os
import re
import zipfile
from collections.abc import Mapping, Sequence
from datetime import UTC, datetime, timedelta
from typing import Any
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame, SparkSession

from millrace.functions.errors import HandleClosed, NotFound, checked_options

Value = str | bool | int | float | datetime | None
_M = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
MAX_ROW, MAX_COL = 1_048_576, 16_384


class XlsxError(ValueError):
    pass


def cell_at(text: str) -> tuple[int, int]:
    """``"B3"`` to ``(3, 2)``; no ``$``, no sheet."""
    m = re.fullmatch(r"([A-Za-z]{1,3})([1-9]\d{0,6})", text.strip())
    if not m:
        raise XlsxError(f"bad cell {text!r}")
    col = 0
    for c in m[1].upper():
        col = col * 26 + ord(c) - 64
    if col > MAX_COL or int(m[2]) > MAX_ROW:
        raise XlsxError(f"cell {text!r} is out of the sheet")
    return int(m[2]), col


def cell_name(row: int, col: int) -> str:
    out = ""
    while col:
        col, r = divmod(col - 1, 26)
        out = chr(65 + r) + out
    return f"{out}{row}"


def range_at(text: str) -> tuple[int, int, int, int]:
    a, colon, b = text.partition(":")
    r1, c1 = cell_at(a)
    r2, c2 = cell_at(b) if colon else (r1, c1)
    if r2 < r1 or c2 < c1:
        raise XlsxError(f"range {text!r} doesn't start at its upper left")
    return r1, c1, r2, c2


def _is_date(number: int, formats: Mapping[int, str]) -> bool:
    if 14 <= number <= 22 or 45 <= number <= 47:
        return True
    code = re.sub(r"\"[^\"]*\"|\[[^\]]*\]|\\.", "", formats.get(number, "")).lower()
    return any(x in code for x in ("yy", "dd", "hh", "ss"))


def _number(text: str) -> int | float:
    x = float(text)
    return int(x) if x.is_integer() and -(2**63) <= x < 2**63 else x


def _from_cache(text: str) -> Value:
    """The value of a formula's stored text: boolean, number, time, text in this order."""
    if text.lower() in ("true", "false", "1", "0", "t", "f"):
        return text.lower() in ("true", "1", "t")
    try:
        return _number(text)
    except ValueError:
        pass
    try:
        return datetime.fromisoformat(text.replace("Z", "+00:00"))
    except ValueError:
        return text


class Worksheet:
    """A handle of one sheet; it is stale once its sheet is deleted or its workbook closed."""

    def __init__(self, book: Workbook, name: str, generation: int) -> None:
        self.book, self.name, self.generation = book, name, generation

    def _cells(self) -> dict[tuple[int, int], Value]:
        self.book._check()
        if self.book._generation.get(self.name) != self.generation:
            raise HandleClosed(f"worksheet {self.name!r} is gone")
        return self.book._sheets[self.name]

    def get(self, cell: str) -> Value:
        return self._cells().get(cell_at(cell))

    def set(self, cell: str, value: Value) -> bool:
        _checked(value)
        at = cell_at(cell)
        if value is None:
            self._cells().pop(at, None)
        else:
            self._cells()[at] = value
        return True

    def range(self, text: str) -> list[list[Value]]:
        cells = self._cells()
        r1, c1, r2, c2 = range_at(text)
        return [[cells.get((r, c)) for c in range(c1, c2 + 1)] for r in range(r1, r2 + 1)]

    def write_range(self, where: str, rows: Sequence[Sequence[Value]]) -> bool:
        if not rows or len({len(r) for r in rows}) != 1 or not rows[0]:
            raise XlsxError("rows must be a rectangle")
        r1, c1, r2, c2 = range_at(where)
        if ":" in where and (r2 - r1 + 1, c2 - c1 + 1) != (len(rows), len(rows[0])):
            raise XlsxError("rows don't fit the range")
        for row in rows:
            for v in row:
                _checked(v)
        for i, row in enumerate(rows):
            for j, v in enumerate(row):
                self.set(cell_name(r1 + i, c1 + j), v)
        return True

    def append(self, rows: Sequence[Sequence[Value]]) -> bool:
        last = max((r for r, _ in self._cells()), default=0)
        for i, row in enumerate(rows, 1):
            for j, v in enumerate(row, 1):
                self.set(cell_name(last + i, j), v)
        return True

    def query(self, text: str, given: Mapping[str, Any] | None = None) -> list[Any]:
        """Rows of a range, or objects by its first row (``headers``); trailing rows without a value go with ``trimEmptyRows``."""
        o = checked_options(given, {"headers": False, "trimEmptyRows": False}, "xlsx query")
        rows = self.range(text)
        if o["trimEmptyRows"]:
            while rows and all(v is None or v == "" for v in rows[-1]):
                rows.pop()
        if not o["headers"]:
            return rows
        if not rows:
            return []
        names: list[str] = []
        counts: dict[str, int] = {}
        for k, v in enumerate(rows[0], 1):
            name = str(v).strip() if v is not None else ""
            name = name or f"column_{k}"
            counts[name] = counts.get(name, 0) + 1
            out = name if counts[name] == 1 else f"{name}_{counts[name]}"
            while out in names:
                counts[name] += 1
                out = f"{name}_{counts[name]}"
            names.append(out)
        return [dict(zip(names, r)) for r in rows[1:]]

    def query_one(self, text: str, given: Mapping[str, Any] | None = None) -> Any:
        return next(iter(self.query(text, given)), None)

    def query_count(self, text: str, given: Mapping[str, Any] | None = None) -> int:
        return len(self.query(text, given))

    def query_exists(self, text: str, given: Mapping[str, Any] | None = None) -> bool:
        return bool(self.query(text, given))


def _checked(v: Any) -> None:
    if not (v is None or isinstance(v, str | bool | int | float | datetime)):
        raise XlsxError(f"a cell can't hold {type(v).__name__}")


class Workbook:
    """An editable workbook in memory on the driver; :meth:`cells` gives it as a table."""

    def __init__(self) -> None:
        self._sheets: dict[str, dict[tuple[int, int], Value]] = {"Sheet1": {}}
        self._generation: dict[str, int] = {"Sheet1": 0}
        self._made, self._path, self._closed = 0, None, False

    def _check(self) -> None:
        if self._closed:
            raise HandleClosed("the workbook is closed")

    @classmethod
    def open(cls, path: str) -> Workbook:
        with open(path, "rb") as f:
            book = cls.read(f.read())
        book._path = path
        return book

    @classmethod
    def read(cls, data: bytes) -> Workbook:
        book = cls()
        book._sheets = {name: dict(cells) for name, cells in read_cells(data)}
        book._generation = dict.fromkeys(book._sheets, 0)
        return book

    def sheets(self) -> list[str]:
        self._check()
        return list(self._sheets)

    def sheet(self, name: str) -> Worksheet:
        self._check()
        if name not in self._sheets:
            raise NotFound(f"worksheet {name!r}")
        return Worksheet(self, name, self._generation[name])

    def add_sheet(self, name: str) -> Worksheet:
        self._check()
        if not name or len(name) > 31 or re.search(r"[:\\/?*\[\]]", name) or name.lower() in map(str.lower, self._sheets):
            raise XlsxError(f"bad or used sheet name {name!r}")
        self._made += 1
        self._sheets[name], self._generation[name] = {}, self._made
        return self.sheet(name)

    def delete_sheet(self, name: str) -> bool:
        self.sheet(name)
        if len(self._sheets) == 1:
            raise XlsxError("the last sheet can't be deleted")
        del self._sheets[name], self._generation[name]
        return True

    def save(self) -> bool:
        self._check()
        if self._path is None:
            raise XlsxError("the workbook has no path yet")
        return self.save_as(self._path)

    def save_as(self, path: str) -> bool:
        self._check()
        if not os.path.isdir(os.path.dirname(os.path.abspath(path))):
            raise NotFound(os.path.dirname(path))
        temporary = f"{path}.part"
        with open(temporary, "wb") as f:
            f.write(write_cells(self._sheets))
        os.replace(temporary, path)
        self._path = path
        return True

    def close(self) -> bool:
        self._closed = True
        return True

    def cells(self, spark: SparkSession) -> DataFrame:
        """``(sheet, row, col, type, value)``."""
        self._check()
        rows = [(s, r, c, type(v).__name__, v.isoformat() if isinstance(v, datetime) else str(v)) for s, cells in self._sheets.items() for (r, c), v in sorted(cells.items())]
        return spark.createDataFrame(rows, "sheet string, row int, col int, type string, value string")


def read_cells(data: bytes) -> list[tuple[str, dict[tuple[int, int], Value]]]:
    """Sheets in order with their cells that have a value; error cells have none."""
    try:
        z = zipfile.ZipFile(io.BytesIO(data))
        book = ET.fromstring(z.read("xl/workbook.xml"))
    except (zipfile.BadZipFile, KeyError, ET.ParseError) as e:
        raise XlsxError(f"no workbook: {e}") from None
    with z:
        names = set(z.namelist())
        rels = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        shared = ["".join(t.text or "" for t in si.iter(f"{_M}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_M}si")] if "xl/sharedStrings.xml" in names else []
        formats: dict[int, str] = {}
        styles: list[int] = []
        if "xl/styles.xml" in names:
            st = ET.fromstring(z.read("xl/styles.xml"))
            formats = {int(f.get("numFmtId")): f.get("formatCode", "") for f in st.iter(f"{_M}numFmt")}
            styles = [int(x.get("numFmtId", 0)) for g in st.iter(f"{_M}cellXfs") for x in g]
        pr = book.find(f"{_M}workbookPr")
        epoch = datetime(1904, 1, 1, tzinfo=UTC) if pr is not None and pr.get("date1904") in ("1", "true") else datetime(1899, 12, 30, tzinfo=UTC)
        out = []
        for s in book.iter(f"{_M}sheet"):
            target = rels[s.get(f"{_R}id")].lstrip("/")
            cells: dict[tuple[int, int], Value] = {}
            for c in ET.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")).iter(f"{_M}c"):
                kind, v, style = c.get("t", "n"), c.find(f"{_M}v"), int(c.get("s", 0))
                text = v.text if v is not None else None
                value: Value = None
                if kind == "inlineStr":
                    value = "".join(t.text or "" for t in c.iter(f"{_M}t"))
                elif text is None or kind == "e":
                    value = None
                elif kind == "s":
                    value = shared[int(text)]
                elif c.find(f"{_M}f") is not None:
                    value = text == "1" if kind == "b" else _from_cache(text)
                elif kind == "b":
                    value = text == "1"
                elif kind in ("str", "d"):
                    value = text
                elif style < len(styles) and _is_date(styles[style], formats):
                    value = epoch + timedelta(milliseconds=round(float(text) * 86_400_000))
                else:
                    value = _number(text)
                if value is not None and value != "":
                    cells[cell_at(c.get("r"))] = value
            out.append((s.get("name"), cells))
    return out


def write_cells(sheets: Mapping[str, Mapping[tuple[int, int], Value]]) -> bytes:
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
    main, office, package = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships", "http://schemas.openxmlformats.org/package/2006"
    n = range(1, len(sheets) + 1)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{kind}.styles+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i in n) + "</Types>")
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{main}" xmlns:r="{office}"><sheets>' + "".join(f'<sheet name={quoteattr(s)} sheetId="{i}" r:id="rId{i}"/>' for i, s in zip(n, sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{package}/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{office}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in n) + f'<Relationship Id="rId{len(sheets) + 1}" Type="{office}/styles" Target="styles.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'{head}<styleSheet xmlns="{main}"><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="22" applyNumberFormat="1"/></cellXfs></styleSheet>')
        for i, cells in zip(n, sheets.values()):
            rows: dict[int, list[str]] = {}
            for (r, c), v in sorted(cells.items()):
                at = cell_name(r, c)
                if isinstance(v, bool):
                    x = f'<c r="{at}" t="b"><v>{int(v)}</v></c>'
                elif isinstance(v, int | float):
                    x = f'<c r="{at}"><v>{v!r}</v></c>'
                elif isinstance(v, datetime):
                    days = (v - datetime(1899, 12, 30, tzinfo=v.tzinfo)) / timedelta(days=1)
                    x = f'<c r="{at}" s="1"><v>{days!r}</v></c>'
                else:
                    x = f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'
                rows.setdefault(r, []).append(x)
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'{head}<worksheet xmlns="{main}"><sheetData>' + "".join(f'<row r="{r}">{"".join(x)}</row>' for r, x in rows.items()) + "</sheetData></worksheet>")
    return out.getvalue()
