"""A folder of workbook versions as a stream: <root>/<workbook_id>/<version_id>.xlsx.

    spark.dataSource.register(HistorySource)
    versions = spark.readStream.format("tabloom_history").option("root", root).load()
    audit.start(versions, contents(spark, root), trail, checkpoint)

An offset holds, for each workbook, the greatest version id and how many versions there are up to it. A micro-batch gives
the versions after one offset up to another, so it can be given again after a failure. If a version appears below an
offset, the stream ends with an error: it would never be given. A folder of more workbooks than an offset should hold is
read as several streams (options shards and shard, by crc32 of the workbook id).

Folders are listed and files opened through Arrow's file systems, by the scheme of the address, on the driver and in tasks
alike. Names that aren't digits and .xlsx, in any case, are left out.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..plans.catalog import Inconsistent
from .xlsx import cells_of

VERSIONS = "workbook_id bigint, version_id string, path string"
#: What is read of a version: its cells, and one row with its file's digest and no sheet.
CONTENT = "workbook_id bigint, version_id string, sheet string, row bigint, column bigint, text string, key string, digest string"
#: Versions of a partition of the stream.
GROUP = 1000


def file_system(address: str) -> tuple[pafs.FileSystem, str]:
    """The file system of an address, and the path there; without a scheme it is a local one."""
    return pafs.FileSystem.from_uri(address if "://" in address else f"file://{address}")


def read_file(address: str) -> bytes:
    fs, path = file_system(address)
    with fs.open_input_file(path) as f:
        return f.read()


def listed(root: str, shards: int = 1, shard: int = 0) -> dict[str, list[tuple[int, str]]]:
    """workbook -> (version, path), ascending; of equal numbers, such as 7 and 007, the first name."""
    fs, top = file_system(root)
    found: dict[str, dict[int, str]] = {}
    for book in fs.get_file_info(pafs.FileSelector(top, allow_not_found=True)):
        if book.type != pafs.FileType.Directory or not book.base_name.isdecimal() or zlib.crc32(str(int(book.base_name)).encode()) % shards != shard:
            continue
        own = found.setdefault(str(int(book.base_name)), {})
        for f in sorted(fs.get_file_info(pafs.FileSelector(book.path)), key=lambda f: f.base_name):
            stem, dot, kind = f.base_name.rpartition(".")
            if f.type == pafs.FileType.File and dot and kind.lower() == "xlsx" and stem.isascii() and stem.isdecimal():
                own.setdefault(int(stem), f"{root.rstrip('/')}/{book.base_name}/{f.base_name}")
    return {book: sorted(own.items()) for book, own in sorted(found.items(), key=lambda x: int(x[0])) if own}


class HistorySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tabloom_history"

    def schema(self) -> str:
        return VERSIONS

    def _options(self) -> tuple[str, int, int]:
        return self.options["root"], int(self.options.get("shards", 1)), int(self.options.get("shard", 0))

    def reader(self, schema) -> DataSourceReader:
        return HistoryReader(*self._options())

    def streamReader(self, schema) -> DataSourceStreamReader:
        return HistoryStream(*self._options())


class Versions(InputPartition):
    def __init__(self, rows: list[tuple[int, str, str]]):
        self.rows = rows


def _groups(rows: list[tuple[int, str, str]]) -> list[Versions]:
    return [Versions(rows[at : at + GROUP]) for at in range(0, len(rows), GROUP)]


class HistoryReader(DataSourceReader):
    """All versions that are there."""

    def __init__(self, root: str, shards: int, shard: int):
        self.where = (root, shards, shard)

    def partitions(self) -> list[Versions]:
        return _groups([(int(book), str(n), path) for book, own in listed(*self.where).items() for n, path in own])

    def read(self, partition: Versions) -> Iterator[tuple]:
        yield from partition.rows


class HistoryStream(DataSourceStreamReader):
    def __init__(self, root: str, shards: int, shard: int):
        self.where = (root, shards, shard)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {book: [own[-1][0], len(own)] for book, own in listed(*self.where).items()}

    def partitions(self, start: dict, end: dict) -> list[Versions]:
        rows: list[tuple[int, str, str]] = []
        there = listed(*self.where)
        for book, (last, _) in end.items():
            after, before = start.get(book, [-1, 0])
            own = there.get(book, [])
            if sum(n <= after for n, _ in own) != before:
                raise Inconsistent(f"workbook {book}: versions up to {after} are not those that were given")
            rows += [(int(book), str(n), path) for n, path in own if after < n <= last]
        return _groups(rows)

    def read(self, partition: Versions) -> Iterator[tuple]:
        yield from partition.rows


def content_rows(book: int, version: str, path: str) -> Iterator[tuple]:
    """CONTENT of a version; none if its file isn't there."""
    try:
        data = read_file(path)
    except FileNotFoundError:
        return
    yield book, version, None, None, None, None, None, hashlib.sha256(data).hexdigest()
    for _, sheet, row, column, _, _, text, key, _ in cells_of(path, data):
        yield book, version, sheet, row, column, text, key, None


def read_contents(versions: DataFrame) -> DataFrame:
    """CONTENT of versions (VERSIONS): each file is opened by the task that has its row."""
    from .incremental import _batches, _fields

    fields = _fields(CONTENT)

    def run(batches):
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("workbook_id", "version_id", "path")), strict=True)
            yield from _batches((cell for r in rows for cell in content_rows(*r)), fields)

    # Few slim rows stand for many bytes: each is a task's, as far as there are tasks.
    n = min(versions.count(), versions.sparkSession.sparkContext.defaultParallelism * 4)
    return versions.select("workbook_id", "version_id", "path").repartition(max(1, n), "workbook_id", "version_id").mapInArrow(run, CONTENT)


def contents(spark: SparkSession, root: str) -> Callable[[DataFrame], DataFrame]:
    """What the audit reads versions with: CONTENT of those versions (workbook_id, version_id) that have a file below root."""

    def read(versions: DataFrame) -> DataFrame:
        there = spark.read.format(HistorySource.name()).option("root", root).load()
        return read_contents(versions.join(there, ["workbook_id", "version_id"]))

    spark.dataSource.register(HistorySource)
    return read
