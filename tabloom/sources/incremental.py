"""Incremental scan of workbook versions: rows are kept by their content, and only those that changed are parsed.

One pass over the files splits the XML of each sheet into rows without parsing it. A row is kept with all that its values
depend on besides: the shared strings that it names, which of its styles are dates, the date epoch, and, for a row with a
shared formula, the master formulas before it. The digest of these is the row's content: rows with equal digests have equal
cells, in whatever version, sheet or workbook they are. Versions are joined with the ones before them on (sheet, row) by
digest; then each content that changed is parsed once, from what was kept, so that a file is read once and its bytes are in
no join. RowStore keeps the rows for later runs, which read new files only.

A sheet whose bytes can't be split safely (comments, CDATA, document types) is parsed as a whole, with equal results.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.diff import snapshot_diff
from .xlsx import Workbook, equality, local

INDEX = "path string, sheet string, row_key string, digest string, cells bigint"
#: strings: numbered texts that the row names; dates: its styles that show dates; masters: shared formulas it may follow.
STORED = f"{INDEX}, head binary, xml binary, strings map<int, string>, dates array<int>, epoch_1904 boolean, masters map<string, array<string>>"
CONTENT = "digest string, column bigint, address string, kind string, text string, key string, style bigint"
#: Rows of digests that are broadcast, of some 70 bytes each; files that a job of RowStore.add reads.
NARROW, FILES = 100_000, 10_000
_ROW = re.compile(rb"<((?:\w+:)?)row\b(?:[^>]*?/>|.*?</\1row\s*>)", re.DOTALL)
_NUMBER = re.compile(rb"<(?:\w+:)?row\b[^>]*?\sr=[\"'](\d+)[\"']")
_STRING = re.compile(rb"\bt=[\"']s[\"'][^>]*>\s*<(?:\w+:)?v[^>]*>\s*(\d+)\s*<")
_IS_STRING = re.compile(rb"\bt=[\"']s[\"']")
_STYLE = re.compile(rb"\bs=[\"'](\d+)[\"']")
_SHARED = re.compile(rb"<(?:\w+:)?f\b[^>]*\bt=[\"']shared[\"']")
_CELL = re.compile(rb"<(?:\w+:)?c[\s/>]")
_HEAD = re.compile(rb"<(?:\w+:)?worksheet\b[^>]*>")


class Sheet:
    """The rows of a sheet as bytes: (row number # how often it came before, XML)."""

    def __init__(self, book: Workbook, part: str):
        data = book.zip.read(part)
        self.whole = b"<!--" in data or b"<![CDATA[" in data or b"<!DOCTYPE" in data
        head = _HEAD.search(data)
        # A row's XML is parsed inside the sheet's own element, which names its name spaces.
        self.head = head[0].rstrip(b"/>") + b">" if head else b"<worksheet>"
        self.rows: list[tuple[str, int, bytes]] = []
        seen: dict[int, int] = {}
        number = 0
        if self.whole:
            source = ((n, ET.tostring(e)) for n, e in book.rows(part))
        else:
            source = ((None, m[0]) for m in _ROW.finditer(data))
        for n, xml in source:
            if n is None:
                m = _NUMBER.match(xml)
                n = int(m[1]) if m else number + 1
            number = n
            at = seen.get(n, 0)
            seen[n] = at + 1
            self.rows.append((f"{n}#{at}", n, xml))
        if self.whole:
            self.head = b"<worksheet>"


def parsed(head: bytes, xml: bytes) -> ET.Element:
    """A row inside of its sheet's own element, which names its name spaces."""
    return ET.fromstring(head + xml + b"</" + re.match(rb"<([\w:]+)", head)[1] + b">")[0]


def _named(row: bytes, head: bytes) -> list[int]:
    """The numbers of the shared strings that a row names."""
    marks = _IS_STRING.findall(row)
    found = [int(i) for i in _STRING.findall(row)] if marks else []
    if len(found) == len(marks):
        return found
    return [int(v.text) for c in parsed(head, row) if c.get("t") == "s" for v in c if local(v.tag) == "v" and v.text]


def stored_of(path: str, content: bytes) -> Iterator[tuple]:
    """STORED of every row of a workbook: no row is parsed but those with master formulas."""
    book = Workbook(content)
    for sheet, part, _ in book.sheets:
        s = Sheet(book, part)
        masters: dict[str, list[str]] = {}
        for key, _, xml in s.rows:
            strings = {i: book.string(i) for i in _named(xml, s.head)}
            dates = sorted({i for i in map(int, _STYLE.findall(xml)) if book.is_date(i)})
            follows: dict[str, list[str]] = {}
            if _SHARED.search(xml):
                for c in parsed(s.head, xml):
                    for f in c:
                        if local(f.tag) == "f" and f.get("t") == "shared":
                            si = f.get("si") or ""
                            if f.text:
                                masters[si] = [f.text, c.get("r") or ""]
                            elif si in masters:
                                follows.setdefault(si, masters[si])
            depends = json.dumps([sorted(strings.items()), dates, book.epoch_1904, sorted(follows.items())], ensure_ascii=True)
            digest = hashlib.sha256(s.head + xml + depends.encode()).hexdigest()
            yield path, sheet, key, digest, len(_CELL.findall(xml)), s.head, xml, list(strings.items()), dates, book.epoch_1904, list(follows.items())


def index_of(path: str, content: bytes) -> Iterator[tuple]:
    """INDEX of every row."""
    return (r[:5] for r in stored_of(path, content))


class Kept(Workbook):
    """What a stored row's values depend on, in the place of its workbook."""

    def __init__(self, strings: dict[int, str], dates: list[int], epoch_1904: bool):
        self.known, self.date_styles, self.epoch_1904 = strings, set(dates), epoch_1904

    def string(self, i: int) -> str:
        return self.known[i]

    def is_date(self, style: int) -> bool:
        return style in self.date_styles


def content_cells(head: bytes, xml: bytes, strings: dict[int, str], dates: list[int], epoch_1904: bool, masters: dict[str, list[str]]) -> Iterator[tuple]:
    """column, address, kind, text, key, style of a stored row's cells, as in a full read of its workbook."""
    known = {si: tuple(m) for si, m in masters.items()}
    for column, address, kind, value, style in Kept(strings, dates, epoch_1904).row_cells(parsed(head, xml), known):
        yield column, address, kind, str(value), equality(kind, value), style


def cells_of_rows(path: str, content: bytes, wanted: set[tuple[str, str]]) -> Iterator[tuple]:
    """CELLS of the wanted (sheet, row key) of a workbook alone."""
    for _, sheet, key, _, _, head, xml, strings, dates, epoch, masters in stored_of(path, content):
        if (sheet, key) in wanted:
            for cell in content_cells(head, xml, dict(strings), dates, epoch, dict(masters)):
                yield path, sheet, int(key.split("#")[0]), *cell


def _fields(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def _batches(rows: Iterator[tuple], fields: pa.Schema, size: int = 20_000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), fields, strict=True)], schema=fields)

    for r in rows:
        held.append(r)
        if len(held) == size:
            yield batch()
            held = []
    if held:
        yield batch()


def read_stored(files: DataFrame) -> DataFrame:
    """STORED of all rows of files (path, content)."""
    fields = _fields(STORED)

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                yield from _batches(stored_of(path, content), fields)

    return files.select("path", "content").mapInArrow(run, STORED)


def read_index(files: DataFrame) -> DataFrame:
    """INDEX of all rows of files (path, content)."""
    return read_stored(files).select(*[f.split(" ")[0] for f in INDEX.split(", ")])


def changed_rows(index: DataFrame, versions: DataFrame) -> DataFrame:
    """workbook, pair, sheet, row_key, path, side, digest of the rows that two neighbouring versions don't share.

    versions: workbook, seq, path. pair is the seq of the later one; a row of the earlier version is listed with its own
    path.
    """
    w = Window.partitionBy("workbook").orderBy("seq")
    chain = versions.select("workbook", "seq", "path", F.lag("path").over(w).alias("previous")).filter("previous is not null")
    now = chain.select("workbook", F.col("seq").alias("pair"), "path").join(index, "path").select("workbook", "pair", "path", "sheet", "row_key", "digest")
    before = chain.select("workbook", F.col("seq").alias("pair"), F.col("previous").alias("path")).join(index, "path").select("workbook", "pair", F.col("path").alias("old_path"), "sheet", "row_key", F.col("digest").alias("old_digest"))
    both = now.join(before, ["workbook", "pair", "sheet", "row_key"], "full_outer").filter(~F.col("digest").eqNullSafe(F.col("old_digest")))
    side = lambda path, name, digest: F.struct(F.col(path).alias("path"), F.lit(name).alias("side"), F.col(digest).alias("digest"))
    sides = F.filter(F.array(side("path", "current", "digest"), side("old_path", "previous", "old_digest")), lambda x: x["path"].isNotNull())
    return both.select("workbook", "pair", "sheet", "row_key", F.explode(sides).alias("x")).select("workbook", "pair", "sheet", "row_key", "x.*")


def parse_contents(stored: DataFrame, digests: DataFrame) -> DataFrame:
    """CONTENT of each of the digests, from one of the rows that have it."""
    fields = _fields(CONTENT)
    own = digests.select(F.col("digest").alias("_digest")).distinct()
    few = own.limit(NARROW + 1).count() <= NARROW
    rows = stored.select("digest", "head", "xml", "strings", "dates", "epoch_1904", "masters").join(F.broadcast(own) if few else own, F.col("digest") == F.col("_digest"), "left_semi")
    # Of a task's rows with a content one is sent on.
    one = rows.groupBy("digest").agg(F.first(F.struct("head", "xml", "strings", "dates", "epoch_1904", F.map_entries("masters").alias("masters"))).alias("r")).select("digest", "r.*")

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                strings, masters = dict(r["strings"]), {m["key"]: m["value"] for m in r["masters"]}
                rows += [(r["digest"], *c) for c in content_cells(r["head"], r["xml"], strings, r["dates"], r["epoch_1904"], masters)]
            yield from _batches(iter(rows), fields)

    return one.mapInArrow(run, CONTENT)


def files_of(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[xX][lL][sS][xX]").load(paths).select("path", "content")


def stored_changes(stored: DataFrame, versions: DataFrame, stage=lambda df: df) -> DataFrame:
    """workbook, pair, and the changes of each pair of neighbouring versions, of rows that were kept."""
    index = stored.select(*[f.split(" ")[0] for f in INDEX.split(", ")])
    wanted = stage(changed_rows(index, versions))
    cells = stage(parse_contents(stored, wanted))
    keys = wanted.select("workbook", "pair", "side", "sheet", F.split("row_key", "#")[0].cast("bigint").alias("row"), "digest")
    side = lambda s: keys.filter(F.col("side") == s).join(cells, "digest")
    return snapshot_diff(side("previous"), side("current"), ["workbook", "pair"])


def incremental_changes(files: DataFrame, versions: DataFrame, stage=lambda df: df) -> DataFrame:
    """The changes of each pair of neighbouring versions. stage writes what is used again: with it, a file is read once."""
    return stored_changes(stage(read_stored(files)), versions, stage)


class RowStore:
    """Rows of workbook versions, kept by content under a folder that all executors share.

    Each call of add() writes a part of its own, and the list of files that it holds last: files of a part without one, which
    broke off, are read again and its rows are not used.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _read(self, table: str, schema: str) -> DataFrame:
        from pyspark.errors import AnalysisException

        try:
            return self.spark.read.schema(f"{schema}, part string").parquet(f"{self.folder}/{table}")
        except AnalysisException:  # nothing was written yet
            return self.spark.createDataFrame([], f"{schema}, part string")

    def files(self) -> DataFrame:
        """path, part of the files that are kept."""
        return self._read("files", "path string")

    def add(self, paths: str | list[str]) -> int:
        """Read the files that are not kept yet, each once; gives their number.

        The driver lists paths, as Spark does for any read of files, and reads them in jobs of FILES.
        """
        listed = files_of(self.spark, paths).select("path")  # without their contents
        new = sorted(r[0] for r in listed.join(self.files().select("path"), "path", "left_anti").collect())
        for at in range(0, len(new), FILES):
            own, part = new[at : at + FILES], uuid.uuid4().hex
            read_stored(files_of(self.spark, own)).write.parquet(f"{self.folder}/rows/part={part}")
            self.spark.createDataFrame([(p,) for p in own], "path string").coalesce(1).write.parquet(f"{self.folder}/files/part={part}")
        return len(new)

    def stored(self) -> DataFrame:
        """STORED of the files that are kept."""
        whole = F.broadcast(self.files().select("part").distinct())  # a row for each call of add()
        return self._read("rows", STORED).join(whole, "part", "left_semi").drop("part")

    def changes(self, versions: DataFrame) -> DataFrame:
        """workbook, pair, and the changes of each pair of neighbouring versions (workbook, seq, path)."""
        made = iter(range(9))

        def stage(df: DataFrame) -> DataFrame:
            at = f"{self.folder}/staging/{uuid.uuid4().hex}-{next(made)}"
            df.write.parquet(at)
            return self.spark.read.schema(df.schema).parquet(at)

        return stored_changes(self.stored(), versions, stage)

    def reuse(self, versions: DataFrame) -> DataFrame:
        """rows and cells of the versions, those of them whose content an earlier version has, and so is not parsed again."""
        index = self.stored().select("path", "digest", "cells").join(versions.select("workbook", "seq", "path"), "path")
        first = index.groupBy("workbook", "digest").agg(F.min("seq").alias("_first"))
        again = index.join(first, ["workbook", "digest"]).withColumn("kept", F.col("seq") > F.col("_first"))
        total = lambda c: F.coalesce(F.sum(c), F.lit(0))
        return again.groupBy("workbook").agg(F.count("*").alias("rows"), total("cells").alias("cells"), F.count_if("kept").alias("rows_reused"), total(F.when(F.col("kept"), F.col("cells"))).alias("cells_reused"))
