"""Reports as workbooks: DataFrames written as .xlsx files by tasks, and read again to be checked.

Each sheet of a report has up to per_sheet rows under a header. A workbook file holds one such sheet, so files are written
by as many tasks as there are sheets; rows of a sheet are dealt to its task in order and streamed into the file, which
no task holds as a whole. Files have names of their own attempt; the manifest names those that count.
"""

from __future__ import annotations

import io
import posixpath
import uuid
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cells import equality_key
from ..operators.sequences import sheets
from .incremental import files_of
from .xlsx import cells_of

PER_SHEET = 900_000
MANIFEST = "sheet string, sheet_no bigint, file string, n bigint, first string, last string"
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
#: What XML 1.0 can't hold.
_FORBIDDEN = dict.fromkeys([*range(0, 9), 11, 12, *range(14, 32), 0xFFFE, 0xFFFF])


def letters(n: int) -> str:
    out = ""
    while n > 0:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def row_xml(number: int, values: list) -> str:
    """A row: numbers and booleans as such, other values as text; nulls are left out."""
    out = []
    for i, v in enumerate(values, 1):
        at = f"{letters(i)}{number}"
        if v is None:
            continue
        if isinstance(v, bool):
            out.append(f'<c r="{at}" t="b"><v>{int(v)}</v></c>')
        elif isinstance(v, int) and abs(v) < 10**15 or isinstance(v, float) and v == v and abs(v) != float("inf"):
            out.append(f'<c r="{at}"><v>{v!r}</v></c>')
        else:
            out.append(f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v).translate(_FORBIDDEN))}</t></is></c>')
    return f'<row r="{number}">{"".join(out)}</row>'


class SheetFile:
    """A workbook of one sheet, written row by row."""

    def __init__(self, to, sheet: str, header: list[str]):
        self.zip = zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED, compresslevel=1)
        put = self.zip.writestr
        put("[Content_Types].xml", f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>')
        put("_rels/.rels", f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        put("xl/workbook.xml", f'<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets><sheet name="{escape(sheet[:31], {chr(34): "&quot;"})}" sheetId="1" r:id="rId1"/></sheets></workbook>')
        put("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_REL}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        self.part = self.zip.open("xl/worksheets/sheet1.xml", "w", force_zip64=True)
        self.part.write(f'<worksheet xmlns="{_MAIN}"><sheetData>'.encode())
        self.number = 0
        self.add([header])

    def add(self, rows: list[list]) -> None:
        made = []
        for values in rows:
            self.number += 1
            made.append(row_xml(self.number, values))
        self.part.write("".join(made).encode("utf-8", "replace"))

    def close(self) -> None:
        self.part.write(b"</sheetData></worksheet>")
        self.part.close()
        self.zip.close()


def sheet_name(sheet: str, number: int, numbered: bool) -> str:
    return f"{sheet}_{number:03d}" if numbered else sheet


def write_report(rows: DataFrame, folder: str, sheet: str, order: str, columns: list[str], per_sheet: int = PER_SHEET, numbered: bool = True) -> DataFrame:
    """Write the columns of rows, in the order of a unique whole number, as sheets; gives the manifest (one row a sheet)."""
    spark = rows.sparkSession
    dealt = sheets(rows.select(*dict.fromkeys([order, *columns])), order, per_sheet).select("sheet_no", "seq", F.struct(*columns).alias("values"), F.col(order).cast("string").alias("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        at = out = to = name = None
        n, first, last = 0, None, None

        def end() -> pa.RecordBatch:
            out.close()
            to.close()
            return pa.RecordBatch.from_arrays([pa.array([sheet_name(sheet, at, numbered)]), pa.array([at], pa.int64()), pa.array([name]), pa.array([n], pa.int64()), pa.array([first]), pa.array([last])], names=["sheet", "sheet_no", "file", "n", "first", "last"])

        for batch in batches:
            numbers, keys, values = (batch.column(c).to_pylist() for c in ("sheet_no", "key", "values"))
            start = 0
            for i in range(len(numbers) + 1):
                if i == len(numbers) or numbers[i] != at:
                    if at is not None and i > start:
                        out.add([[v[c] for c in columns] for v in values[start:i]])
                        n, first, last = n + i - start, keys[start] if first is None else first, keys[i - 1]
                    start = i
                    if i < len(numbers):
                        if at is not None:
                            yield end()
                        at, n, first, last = numbers[i], 0, None, None
                        name = f"{sheet_name(sheet, at, numbered)}-{uuid.uuid4().hex}.xlsx"
                        to = fs.open_output_stream(posixpath.join(base, name))
                        out = SheetFile(_Forward(to), sheet_name(sheet, at, numbered), columns)
        if at is not None:
            yield end()

    written = dealt.repartition("sheet_no").sortWithinPartitions("sheet_no", "seq").mapInArrow(run, MANIFEST)
    path = f"{folder.rstrip('/')}/_manifest-{uuid.uuid4().hex}"
    written.write.parquet(path)
    return spark.read.schema(MANIFEST).parquet(path)


class _Forward(io.RawIOBase):
    """A stream that can only be written on, as zip files need it."""

    def __init__(self, to):
        self.to, self.at = to, 0

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.to.write(bytes(data))
        self.at += len(data)
        return len(data)

    def tell(self) -> int:
        return self.at

    def seekable(self) -> bool:
        return False

    def flush(self) -> None:
        pass


def check_report(manifest: DataFrame, folder: str, key_column: int = 1) -> DataFrame:
    """sheet, problem of written sheets, from reading their files again; no rows if all is well.

    A sheet must be there once, under its name, with as many rows as were written, its keys in strictly ascending order
    and the first and last one as they were written.
    """
    spark = manifest.sparkSession
    files = files_of(spark, folder).withColumn("file", F.element_at(F.split("path", "/"), -1)).join(manifest.select("file"), "file", "left_semi")

    def run(batches):
        for batch in batches:
            for file, content in zip(batch.column("file").to_pylist(), batch.column("content").to_pylist(), strict=True):
                found = [(file, r[1], r[2], r[6], r[7]) for r in cells_of(file, content) if r[3] == key_column and r[2] > 1]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], names=["file", "in_sheet", "row", "text", "key"])

    from pyspark.sql import Window

    cells = files.select("file", "content").mapInArrow(run, "file string, in_sheet string, row bigint, text string, key string")
    number = F.col("text").try_cast("decimal(38,0)")
    ordered = cells.withColumn("up", F.coalesce(number > F.lag(number).over(Window.partitionBy("file").orderBy("row")), F.lit(True)))
    per = ordered.groupBy("file").agg(F.count("*").alias("read"), F.min("in_sheet").alias("in_sheet"), F.max("in_sheet").alias("other_sheet"), F.bool_and("up").alias("up"), F.min_by("key", "row").alias("first_key"), F.max_by("key", "row").alias("last_key"))
    as_key = lambda c: equality_key(F.lit("num"), F.col(c))
    both = manifest.join(per, "file", "left")
    problem = (
        F.when(F.coalesce("read", F.lit(0)) != F.col("n"), "rows are missing")
        .when((F.col("in_sheet") != F.col("sheet")) | (F.col("other_sheet") != F.col("sheet")), "another sheet")
        .when(~F.col("up"), "not in order")
        .when((F.col("first_key") != as_key("first")) | (F.col("last_key") != as_key("last")), "other first or last row")
    )
    return both.select("sheet", problem.alias("problem")).filter("problem is not null")
