"""Workbooks (.xlsx) as rows of typed cells, read by tasks from the bytes of their files.

A workbook is a zip of XML parts. Each file is one row of Spark's binaryFile source, so files are spread over tasks; a
task streams through a sheet's XML and never holds its tree. Values keep their types: kind is str, num, bool, datetime,
date or time, and text is what Python's str() makes of the value.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import io
import json
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.formulas import shift_formula

CELLS = "path string, sheet string, row bigint, column bigint, address string, kind string, text string, key string, style bigint"
ROWS = "path string, sheet string, row_key string, row_sha string, cells bigint, parsable boolean, deps_sha string"
SHEETS = "path string, sheet string, position bigint, state string, sheet_sha string, cells bigint"
#: Number formats that show dates or times, by their ids.
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
_ADDRESS = re.compile(r"^([A-Z]+)([1-9][0-9]*)$")


class NotAWorkbook(ValueError):
    pass


def local(tag: str) -> str:
    return tag[tag.rfind("}") + 1 :]


@lru_cache(1 << 14)
def column_index(letters: str) -> int:
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n


def is_date_format(code: str) -> bool:
    """Does a format show date or time parts, outside of quoted text, brackets and escapes?"""
    bare = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.|_.|\*.', "", code.lower())
    return bare != "general" and bool(re.search(r"[dmyhs]", bare))


def all_text(e: ET.Element) -> str:
    """A string item's text: its t elements and those of its runs, without phonetic ones."""
    out = []
    for child in e:
        name = local(child.tag)
        if name == "t":
            out.append(child.text or "")
        elif name == "r":
            out += [t.text or "" for t in child if local(t.tag) == "t"]
    return "".join(out)


def equality(kind: str, value) -> str:
    if kind != "num":
        return f"{kind}:{value}"
    return f"num:{int(value)}" if value == value and abs(value) != float("inf") and float(value).is_integer() else f"num:{value!r}"


def from_serial(serial: float, epoch_1904: bool):
    """A date serial as datetime; below 1 a time of day. The day that 1900 didn't have is skipped."""
    if 0 <= serial < 1:
        return "time", (dt.datetime(1900, 1, 1) + dt.timedelta(days=serial, microseconds=0)).replace(microsecond=0).time()
    start = dt.datetime(1904, 1, 1) if epoch_1904 else dt.datetime(1899, 12, 30)
    if not epoch_1904 and serial < 60:
        serial += 1
    whole = start + dt.timedelta(days=serial)
    return "datetime", (whole + dt.timedelta(microseconds=500)).replace(microsecond=(whole + dt.timedelta(microseconds=500)).microsecond // 1000 * 1000)


class Workbook:
    """The parts of a workbook that its cells depend on."""

    def __init__(self, content: bytes):
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(content))
            names = set(self.zip.namelist())
        except zipfile.BadZipFile as e:
            raise NotAWorkbook(str(e)) from e
        if "xl/workbook.xml" not in names or "[Content_Types].xml" not in names:
            raise NotAWorkbook("parts of a workbook are missing")
        self.names = names
        book = ET.fromstring(self.zip.read("xl/workbook.xml"))
        pr = next((e for e in book if local(e.tag) == "workbookPr"), None)
        self.epoch_1904 = pr is not None and pr.get("date1904") in ("1", "true")
        self.strings = self._strings()
        self.dates = self._dates()
        self.sheets = self._sheets(book)

    def _part(self, name: str) -> bytes | None:
        return self.zip.read(name) if name in self.names else None

    def _strings(self) -> list[str]:
        data = self._part("xl/sharedStrings.xml")
        return [all_text(e) for e in ET.fromstring(data) if local(e.tag) == "si"] if data else []

    def _dates(self) -> list[bool]:
        """Per cell style: is it a date? A workbook's own format goes before a built-in one of the same id."""
        data = self._part("xl/styles.xml")
        if not data:
            return []
        root = ET.fromstring(data)
        own = {int(e.get("numFmtId")): e.get("formatCode", "") for part in root if local(part.tag) == "numFmts" for e in part}
        styles = [int(e.get("numFmtId", 0)) for part in root if local(part.tag) == "cellXfs" for e in part]
        return [is_date_format(own[i]) if i in own else i in DATE_FORMATS for i in styles]

    def _sheets(self, book: ET.Element) -> list[tuple[str, str, str]]:
        rels = self._part("xl/_rels/workbook.xml.rels")
        targets = {e.get("Id"): e.get("Target", "") for e in ET.fromstring(rels)} if rels else {}
        out = []
        for part in book:
            if local(part.tag) != "sheets":
                continue
            for e in part:
                rel = next((v for k, v in e.attrib.items() if local(k) == "id" and k != "sheetId"), None)
                target = targets.get(rel)
                if e.get("name") is None or not target:
                    continue
                at = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
                if at in self.names and "worksheets" in at:
                    out.append((e.get("name"), at, e.get("state", "visible")))
        return out

    def dependencies(self) -> str:
        """A digest of what a row's values depend on beside its own XML."""
        h = hashlib.sha256(b"1904" if self.epoch_1904 else b"1900")
        for name in ("xl/sharedStrings.xml", "xl/styles.xml"):
            h.update(hashlib.sha256(self._part(name) or b"missing").digest())
        return h.hexdigest()

    def string(self, i: int) -> str:
        if not 0 <= i < len(self.strings):
            raise NotAWorkbook(f"no shared string {i}")
        return self.strings[i]

    def is_date(self, style: int) -> bool:
        return style < len(self.dates) and self.dates[style]

    def value(self, cell: ET.Element, address: str, masters: dict) -> tuple[str, object] | None:
        """(kind, value) of a cell, or None if it is empty."""
        f = v = inline = None
        for e in cell:
            name = local(e.tag)
            if name == "v":
                v = e
            elif name == "f":
                f = e
            elif name == "is":
                inline = e
        kind = cell.get("t", "n")
        if f is not None:
            return "str", self._formula(f, address, masters)
        if kind == "inlineStr":
            text = all_text(inline) if inline is not None else ""
            return ("str", text) if text else None
        raw = v.text if v is not None else None
        if raw is None:
            return None
        if kind == "s":
            return "str", self.string(int(raw))
        if kind == "b":
            return "bool", raw == "1"
        if kind in ("str", "e"):
            return "str", raw
        if kind == "d":
            when = dt.datetime.fromisoformat(raw)
            return "datetime", when
        number = float(raw) if any(c in raw for c in ".eE") else int(raw)
        if self.is_date(int(cell.get("s", 0))):
            return from_serial(float(number), self.epoch_1904)
        return "num", number

    @staticmethod
    def _formula(f: ET.Element, address: str, masters: dict) -> str:
        kind, text = f.get("t"), f.text or ""
        if kind in ("array", "dataTable"):
            known = {k: v for k, v in sorted({**f.attrib, "text": text}.items())}
            return ("ARRAYFORMULA|" if kind == "array" else "DATATABLEFORMULA|") + json.dumps(known, ensure_ascii=False, separators=(",", ":"), sort_keys=True)
        if kind == "shared":
            si = f.get("si")
            if text:
                masters[si] = (text, address)
            elif si in masters:
                master, origin = masters[si]
                text = shift_formula(master, origin, address)
        return "=" + text

    def rows(self, part: str) -> Iterator[tuple[int, ET.Element]]:
        """(row number, element) in order, one row in memory at a time."""
        number = 0
        with self.zip.open(part) as f:
            for _, e in ET.iterparse(f, events=("end",)):
                if e.tag.endswith("row") and local(e.tag) == "row":
                    number = int(e.get("r", number + 1))
                    yield number, e
                    e.clear()

    def row_cells(self, row: ET.Element, masters: dict) -> Iterator[tuple[int, str, str, object, int]]:
        """column, address, kind, value, style of each cell of a row with a value."""
        column = 0
        for cell in row:
            address = cell.get("r")
            m = _ADDRESS.match(address.upper()) if address else None
            column = column_index(m[1]) if m else column + 1
            found = self.value(cell, address or "", masters)
            if found is not None:
                yield column, address, *found, int(cell.get("s", 0))

    def cells(self, part: str) -> Iterator[tuple[int, int, str, str, object, int]]:
        """row, column, address, kind, value, style of each cell with a value."""
        masters: dict = {}
        for number, row in self.rows(part):
            for cell in self.row_cells(row, masters):
                yield number, *cell


def cells_of(path: str, content: bytes) -> Iterator[tuple]:
    book = Workbook(content)
    for sheet, part, _ in book.sheets:
        for row, column, address, kind, value, style in book.cells(part):
            yield path, sheet, row, column, address, kind, str(value), equality(kind, value), style


def row_index(path: str, content: bytes) -> Iterator[tuple]:
    """A digest per row, without making its values: what is equal with equal dependencies need not be parsed."""
    book = Workbook(content)
    deps = book.dependencies()
    for sheet, part, _ in book.sheets:
        seen: dict[int, int] = {}
        for number, row in book.rows(part):
            xml = ET.tostring(row)
            ordinal = seen.get(number, 0)
            seen[number] = ordinal + 1
            shared = any(local(f.tag) == "f" and f.get("t") == "shared" for c in row for f in c)
            yield path, sheet, f"{number}#{ordinal}", hashlib.sha256(xml).hexdigest(), len(row), not shared, deps


def sheets_of(path: str, content: bytes) -> Iterator[tuple]:
    book = Workbook(content)
    for i, (sheet, part, state) in enumerate(book.sheets):
        data = book.zip.read(part)
        yield path, sheet, i, state, hashlib.sha256(data).hexdigest(), data.count(b"<c ")


def _read(spark: SparkSession, paths: str | list[str], schema: str, make) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[xX][lL][sS][xX]").load(paths)
    names = [f.split(" ")[0] for f in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                rows = []
                for r in make(path, content):
                    rows.append(r)
                    if len(rows) == 50_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=names)

    return files.select("path", "content").mapInArrow(run, schema)


def read_cells(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Cells of workbooks. A file that is not a workbook ends the read with an error."""
    return _read(spark, paths, CELLS, cells_of)


def read_rows(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return _read(spark, paths, ROWS, row_index)


def read_sheets(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Sheets, empty ones too: these have no cells."""
    return _read(spark, paths, SHEETS, sheets_of)


def read_checked(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(files, errors): path and digest of workbooks, and path and message of files that are none."""

    def check(path, content):
        try:
            Workbook(content)
            yield path, hashlib.sha256(content).hexdigest(), None
        except (NotAWorkbook, ET.ParseError, ValueError, KeyError) as e:
            yield path, None, str(e) or type(e).__name__

    found = _read(spark, paths, "path string, digest string, error string", check)
    return found.filter("error is null").select("path", "digest"), found.filter("error is not null").select("path", "error")


class XlsxSource(DataSource):
    """spark.read.format("tabloom_xlsx"): one partition per file of a driver-side list of paths."""

    @classmethod
    def name(cls) -> str:
        return "tabloom_xlsx"

    def schema(self) -> str:
        return CELLS

    def reader(self, schema) -> DataSourceReader:
        return _XlsxReader(self.options.get("paths", "").split(";"))


class _XlsxReader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = [p for p in paths if p]

    def partitions(self):
        return [InputPartition(p) for p in self.paths]

    def read(self, partition):
        from .history import read_file

        yield from cells_of(partition.value, read_file(partition.value))


LAYOUT = "path string, sheet string, item string, first bigint, last bigint, ref string, value string"
STYLES = "path string, sheet string, row bigint, column bigint, part string, value string"
#: What sheet protection can allow or forbid.
PROTECTION = "sheet objects scenarios formatCells formatColumns formatRows insertColumns insertRows insertHyperlinks deleteColumns deleteRows selectLockedCells selectUnlockedCells sort autoFilter pivotTables".split()
STYLE_PARTS = {"fontId": ("fonts", "font"), "fillId": ("fills", "fill"), "borderId": ("borders", "border")}


def _json(x) -> str:
    return json.dumps(x, ensure_ascii=False, sort_keys=True)


def _tree(e: ET.Element):
    """An element as nested maps, without empty ones."""
    out = dict(e.attrib)
    for child in e:
        inner = _tree(child)
        if inner:
            out[local(child.tag)] = inner
    return out


def layout_of(path: str, content: bytes) -> Iterator[tuple]:
    """State, protection, frozen panes, heights, widths and merged ranges of each sheet."""
    book = Workbook(content)
    for sheet, part, state in book.sheets:
        yield path, sheet, "state", 0, 0, "", state
        with book.zip.open(part) as f:
            for _, e in ET.iterparse(f, events=("end",)):
                name = local(e.tag)
                if name == "sheetProtection":
                    yield path, sheet, "protection", 0, 0, "", _json({k: e.get(k) for k in PROTECTION})
                elif name == "pane" and e.get("state") in ("frozen", "frozenSplit"):
                    yield path, sheet, "freeze", 0, 0, "", e.get("topLeftCell", "")
                elif name == "row":
                    if e.get("ht") or e.get("hidden"):
                        yield path, sheet, "row", int(e.get("r")), int(e.get("r")), "", _json({"height": e.get("ht"), "hidden": e.get("hidden") in ("1", "true")})
                    e.clear()
                elif name == "col":
                    yield path, sheet, "column", int(e.get("min")), int(e.get("max")), "", _json({"width": e.get("width"), "hidden": e.get("hidden") in ("1", "true")})
                elif name == "mergeCell":
                    yield path, sheet, "merge", 0, 0, e.get("ref"), e.get("ref")


def styles_of(path: str, content: bytes) -> Iterator[tuple]:
    """The parts of each styled cell, empty ones too."""
    book = Workbook(content)
    data = book._part("xl/styles.xml")
    root = ET.fromstring(data) if data else ET.Element("none")
    lists = {local(p.tag): list(p) for p in root}
    formats = {e.get("numFmtId"): e.get("formatCode") for e in lists.get("numFmts", [])}
    known: list[dict[str, str]] = []
    for xf in lists.get("cellXfs", []):
        parts = {name: _json(_tree(lists[group][int(xf.get(key))])) for key, (group, name) in STYLE_PARTS.items() if xf.get(key) is not None and int(xf.get(key)) < len(lists.get(group, []))}
        parts["number_format"] = formats.get(xf.get("numFmtId"), xf.get("numFmtId") or "0")
        parts |= {local(c.tag): _json(dict(c.attrib)) for c in xf if local(c.tag) in ("alignment", "protection")}
        known.append(parts)
    for sheet, part, _ in book.sheets:
        for number, row in book.rows(part):
            for c in row:
                style, m = int(c.get("s", 0)), _ADDRESS.match((c.get("r") or "").upper())
                if style and m and style < len(known):
                    for name, value in known[style].items():
                        yield path, sheet, number, column_index(m[1]), name, value


def read_layout(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return _read(spark, paths, LAYOUT, layout_of)


def read_styles(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return _read(spark, paths, STYLES, styles_of)
