"""One report workbook of many sheets, written by many tasks.

Each sheet is deflated by the task that has its rows, as a part of its own with its checksum and sizes. One task then joins
the parts to a workbook: it copies their bytes behind each other, piece by piece, and writes the directory; it inflates
nothing and holds no part. The workbook is checked where it lies, a task for each sheet, before it takes the place of the
one that was there; a report that fails leaves the old one.
"""

from __future__ import annotations

import io
import posixpath
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sequences import sheets
from .history import file_system
from .report import _MAIN, _PACKAGE, _REL, PER_SHEET, row_xml, sheet_name
from .xlsx import Workbook

PARTS = "place int, sheet_no bigint, sheet string, file string, crc bigint, packed bigint, size bigint, n bigint, first string, last string"
PIECE = 1 << 20
_BIG = 0xFFFFFFFF


@dataclass
class Sheet:
    """Rows in the order of a unique column, and the titles of the columns that are written. numbered: NAME_001 and so on."""

    name: str
    rows: DataFrame
    order: str
    columns: dict[str, str]
    numbered: bool = False


def _value(c: str, kind: str) -> Column:
    """A cell as (kind, text): n a number, b a boolean, s a text."""
    number = kind in ("tinyint", "smallint", "int", "bigint", "float", "double")
    return F.when(F.col(c).isNotNull(), F.struct(F.lit("n" if number else "b" if kind == "boolean" else "s").alias("k"), F.col(c).cast("string").alias("t")))


def _python(x: dict | None):
    if x is None:
        return None
    if x["k"] == "b":
        return x["t"] == "true"
    if x["k"] == "s":
        return x["t"]
    return float(x["t"]) if any(c in x["t"] for c in ".EeNI") else int(x["t"])


class _Part:
    """A sheet's XML, deflated as it comes."""

    def __init__(self, to, titles: list[str]):
        self.to, self.deflate = to, zlib.compressobj(1, zlib.DEFLATED, -15)
        self.crc = self.packed = self.size = self.number = 0
        self._put(f'<worksheet xmlns="{_MAIN}"><sheetData>'.encode())
        self.add([titles])

    def _put(self, data: bytes, last: bool = False) -> None:
        self.crc, self.size = zlib.crc32(data, self.crc), self.size + len(data)
        out = self.deflate.compress(data) + (self.deflate.flush() if last else b"")
        self.packed += len(out)
        self.to.write(out)

    def add(self, rows: list[list]) -> None:
        made = []
        for values in rows:
            self.number += 1
            made.append(row_xml(self.number, values))
        self._put("".join(made).encode("utf-8", "replace"))

    def close(self) -> None:
        self._put(b"</sheetData></worksheet>", True)
        self.to.close()


def write_parts(spark: SparkSession, folder: str, book: list[Sheet], per_sheet: int = PER_SHEET, place: int = 0) -> DataFrame:
    """Write the sheets' parts below folder, all in one job; gives PARTS, in the order of book from place on."""
    every = None
    for at, s in enumerate(book, place):
        kinds = dict(s.rows.dtypes)
        own = sheets(s.rows.select(*dict.fromkeys([s.order, *s.columns])), s.order, per_sheet if s.numbered else 1 << 62)
        own = own.select(F.lit(at).alias("place"), "sheet_no", "seq", F.array(*[_value(c, kinds[c]) for c in s.columns]).alias("cells"), F.col(s.order).cast("string").alias("key"))
        # A sheet without rows has its header.
        begins = spark.range(1).select(F.lit(at).alias("place"), F.lit(1).cast("bigint").alias("sheet_no"), F.lit(0).cast("bigint").alias("seq"), F.lit(None).cast(own.schema["cells"].dataType).alias("cells"), F.lit(None).cast("string").alias("key"))
        both = own.unionByName(begins)
        every = both if every is None else every.unionByName(both)
    named = {at: (s.name, list(s.columns.values()), s.numbered) for at, s in enumerate(book, place)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(folder)
        fs.create_dir(base, recursive=True)
        at = part = file = first = last = None
        n = 0

        def end() -> pa.RecordBatch:
            part.close()
            row = (at[0], at[1], sheet_name(named[at[0]][0], at[1], named[at[0]][2]), file, part.crc, part.packed, part.size, n, first, last)
            types = [pa.int32(), pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 4, pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names=[f.split(" ")[0] for f in PARTS.split(", ")])

        for batch in batches:
            held: list[list] = []
            for where, number, cells, key in zip(*(batch.column(c).to_pylist() for c in ("place", "sheet_no", "cells", "key")), strict=True):
                if (where, number) != at:
                    if at is not None:
                        part.add(held)
                        held = []
                        yield end()
                    at, n, first, last = (where, number), 0, None, None
                    file = f"{uuid.uuid4().hex}.part"
                    part = _Part(fs.open_output_stream(posixpath.join(base, file)), named[where][1])
                if cells is not None:
                    held.append([_python(c) for c in cells])
                    n, first, last = n + 1, key if first is None else first, key
            if held:
                part.add(held)
        if at is not None:
            yield end()

    written = every.repartition("place", "sheet_no").sortWithinPartitions("place", "sheet_no", "seq").mapInArrow(run, PARTS)
    path = f"{folder.rstrip('/')}/_parts-{uuid.uuid4().hex}"
    written.write.parquet(path)
    return spark.read.schema(PARTS).parquet(path)


class Joined:
    """A zip file of parts that are deflated already."""

    def __init__(self, out):
        self.out, self.at, self.entries = out, 0, []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, name: str, crc: int, packed: int, size: int, pieces) -> None:
        raw, big = name.encode(), packed >= _BIG or size >= _BIG
        extra = struct.pack("<HHQQ", 1, 16, size, packed) if big else b""
        self.entries.append((raw, crc, packed, size, self.at))
        self._put(struct.pack("<4s5H3I2H", b"PK\x03\x04", 45 if big else 20, 0x800, 8, 0, 33, crc, _BIG if big else packed, _BIG if big else size, len(raw), len(extra)) + raw + extra)
        before = self.at
        for piece in pieces:
            self._put(piece)
        if self.at - before != packed:
            raise ValueError(f"{name}: the part has another length than was written")

    def text(self, name: str, xml: str) -> None:
        data, deflate = xml.encode(), zlib.compressobj(6, zlib.DEFLATED, -15)
        packed = deflate.compress(data) + deflate.flush()
        self.add(name, zlib.crc32(data), len(packed), len(data), [packed])

    def close(self) -> None:
        start = self.at
        for raw, crc, packed, size, at in self.entries:
            big = max(packed, size, at) >= _BIG
            extra = struct.pack("<HHQQQ", 1, 24, size, packed, at) if big else b""
            sizes = (_BIG, _BIG) if big else (packed, size)
            self._put(struct.pack("<4s6H3I5H2I", b"PK\x01\x02", 45, 45 if big else 20, 0x800, 8, 0, 33, crc, *sizes, len(raw), len(extra), 0, 0, 0, 0, _BIG if big else at) + raw + extra)
        n, length = len(self.entries), self.at - start
        if n >= 0xFFFF or start >= _BIG or length >= _BIG:
            end = self.at
            self._put(struct.pack("<4sQ2H2I4Q", b"PK\x06\x06", 44, 45, 45, 0, 0, n, n, length, start) + struct.pack("<4sIQI", b"PK\x06\x07", 0, end, 1))
        self._put(struct.pack("<4s4H2IH", b"PK\x05\x06", 0, 0, min(n, 0xFFFF), min(n, 0xFFFF), min(length, _BIG), min(start, _BIG), 0))


def _pieces(f) -> Iterator[bytes]:
    while piece := f.read(PIECE):
        yield piece


def join_parts(parts: DataFrame, folder: str, to: str) -> None:
    """Write the workbook of parts (a row for each sheet) at to: one task copies the parts' bytes."""

    def run(batches):
        rows = sorted((r for batch in batches for r in batch.to_pylist()), key=lambda r: (r["place"], r["sheet_no"]))
        fs, at = file_system(to)
        _, base = file_system(folder)
        names = [escape(r["sheet"][:31], {'"': "&quot;"}) for r in rows]
        if len({n.lower() for n in names}) != len(names):
            raise ValueError("two sheets have one name")
        with fs.open_output_stream(at) as out:
            z = Joined(out)
            types = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(rows) + 1))
            z.text("[Content_Types].xml", f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{types}</Types>')
            z.text("_rels/.rels", f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
            listed = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1))
            z.text("xl/workbook.xml", f'<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>{listed}</sheets></workbook>')
            z.text("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{_PACKAGE}/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{_REL}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(rows) + 1)) + "</Relationships>")
            for i, r in enumerate(rows, 1):
                with fs.open_input_stream(posixpath.join(base, r["file"])) as f:
                    z.add(f"xl/worksheets/sheet{i}.xml", r["crc"], r["packed"], r["size"], _pieces(f))
            z.close()
        yield pa.RecordBatch.from_arrays([pa.array([len(rows)])], names=["n"])

    parts.coalesce(1).mapInArrow(run, "n bigint").collect()  # one number


def check_book(parts: DataFrame, at: str) -> DataFrame:
    """sheet, problem of the sheets of a written workbook; no rows if all is well. Each sheet is read by a task of its own."""

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                fs, path = file_system(at)
                with fs.open_input_file(path) as f:
                    book = _Opened(f)
                    found = [part for name, part, _ in book.sheets if name == r["sheet"][:31]]
                    problem = None if len(found) == 1 else "the sheet is not there once"
                    if problem is None:
                        n = -1  # the header
                        try:
                            for n, (number, _) in enumerate(book.rows(found[0])):
                                if number != n + 1:
                                    problem = "rows have other numbers"
                            problem = problem or (None if n == r["n"] else "rows are missing" if n < r["n"] else "too many rows")
                        except (zipfile.BadZipFile, zlib.error, SyntaxError):
                            problem = "the sheet is damaged"
                if problem:
                    out.append((r["sheet"], problem))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["sheet", "problem"])

    return parts.repartition(max(1, parts.count()), "place", "sheet_no").mapInArrow(run, "sheet string, problem string")


class _Opened(Workbook):
    """A workbook read where it lies: its directory and one sheet."""

    def __init__(self, f):
        import xml.etree.ElementTree as ET

        self.zip = zipfile.ZipFile(io.BufferedReader(_Seekable(f)))
        self.names = set(self.zip.namelist())
        self.sheets = self._sheets(ET.fromstring(self.zip.read("xl/workbook.xml")))


class _Seekable(io.RawIOBase):
    def __init__(self, f):
        self.f = f

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = 0) -> int:
        return self.f.seek(offset, whence)

    def tell(self) -> int:
        return self.f.tell()

    def readinto(self, buffer) -> int:
        data = self.f.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)


def publish(spark: SparkSession, written: str, to: str) -> None:
    """Put a written file in the place of another one, which is kept until then."""
    jvm = spark.sparkContext._jvm
    path = lambda x: jvm.org.apache.hadoop.fs.Path(x)
    fs = path(to).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = path(f"{to}.old")
    if fs.exists(path(to)):
        fs.delete(old, False)
        fs.rename(path(to), old)
    if not fs.rename(path(written), path(to)):
        if fs.exists(old):
            fs.rename(old, path(to))
        raise OSError(f"{to} could not be written")
    fs.delete(old, False)


def write_book(spark: SparkSession, to: str, book: list[Sheet], work: str, per_sheet: int = PER_SHEET, more=None) -> DataFrame:
    """Write, check and publish a workbook; gives its PARTS. work: a folder for parts, which all executors share.

    more: a function from these parts to further sheets, such as one that tells what was written.
    """
    parts = write_parts(spark, work, book, per_sheet)
    if more is not None:
        parts = parts.unionByName(write_parts(spark, work, more(parts), per_sheet, len(book)))
    written = f"{work.rstrip('/')}/{uuid.uuid4().hex}.xlsx"
    join_parts(parts, work, written)
    wrong = check_book(parts, written).head(1)
    if wrong:
        raise ValueError(f"the report was not published: {wrong[0]['sheet']}: {wrong[0]['problem']}")
    publish(spark, written, to)
    return parts
