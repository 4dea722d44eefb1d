"""Listings of a document library: pages of a service's answers, folders below folders, versions of a file."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import json_value, sqlite_integer


def items(pages: DataFrame) -> DataFrame:
    """page, pos, item of answers (page, body): one row per entry, in the answers' order."""
    values = F.from_json(json_value(F.col("body")), "array<string>")
    return pages.select("page", F.posexplode(F.coalesce(values, F.array(F.col("body")))).alias("pos", "item"))


def workbooks(pages: DataFrame) -> DataFrame:
    """Files named .xlsx among the entries."""
    get = lambda p: F.get_json_object("item", p)
    rows = items(pages).select(get("$.id").alias("item_id"), get("$.name").alias("name"), get("$.parentReference.path").alias("path"), get("$.file").isNotNull().alias("is_file"))
    return rows.filter(F.col("is_file") & F.lower("name").endswith(".xlsx")).drop("is_file")


def versions(pages: DataFrame) -> DataFrame:
    """Versions from a service's answers, which begin with the newest: pos ascends with time."""
    get = lambda p: F.get_json_object("item", p)
    rows = items(pages).select("page", "pos", get("$.id").alias("version_id"), get("$.lastModifiedDateTime").alias("modified_at"), get("$.lastModifiedBy.user.displayName").alias("author"), get("$.size").try_cast("bigint").alias("size"))
    return rows.orderBy(F.desc("page"), F.desc("pos"))


def from_id(rows: DataFrame, anchor: int, column: str = "version_id") -> DataFrame:
    """Versions from an id on, which is included; the predicate reaches the scan."""
    return rows.filter(sqlite_integer(F.col(column)) >= anchor)


def below(spark: SparkSession, folders: DataFrame, roots: DataFrame, skip: tuple[str, ...] = ("Forms",)) -> DataFrame:
    """Folders (folder_id, parent_id, name) below roots (folder_id), with depth and path. Cycles end."""
    return spark.sql(
        """
        WITH RECURSIVE tree(folder_id, path, seen, depth) MAX RECURSION LEVEL 1000 AS (
          SELECT f.folder_id, f.name, array(f.folder_id), 0 FROM {folders} f JOIN {roots} r ON f.folder_id = r.folder_id
          UNION ALL
          SELECT f.folder_id, concat(t.path, '/', f.name), array_append(t.seen, f.folder_id), t.depth + 1
          FROM tree t JOIN {folders} f ON f.parent_id = t.folder_id WHERE NOT array_contains(t.seen, f.folder_id)
        ) SELECT folder_id, path, depth FROM tree""",
        folders=folders.filter(~F.col("name").isin(*skip)),
        roots=roots,
    )


def in_name_order(folders: DataFrame, path: str = "path", stable: str = "folder_id") -> DataFrame:
    """Folders by name without case, then by their id."""
    return folders.orderBy(F.lower(path), stable)


def id_of_label(versions: DataFrame, label: str) -> DataFrame:
    """version_id of a label; of several the last in numeric order."""
    return versions.filter(F.col("label") == label).orderBy(F.desc(sqlite_integer(F.col("version_id")))).limit(1).select("version_id")


def last_by_identity(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of entries whose ids differ in case only, the last."""
    rest = [c for c in rows.columns]
    return rows.groupBy(F.lower(key).alias("_k")).agg(F.max_by(F.struct(*rest), order).alias("r")).select("r.*")


#: What blocks() finds of a file.
CHECKED = "file string, blocks bigint, bytes bigint, digest string, problem string"


def blocks(chunks: DataFrame) -> DataFrame:
    """CHECKED of files in base64 blocks (file, offset, data, size): do the blocks follow each other and fill the size?

    A file's blocks come to a task in the order of their offsets, sorted on disk if need be, and its digest is carried from
    block to block: in memory is what Spark hands over at once (spark.sql.execution.arrow.maxBytesPerBatch). The first of
    these is a file's problem: a block that isn't base64, a gap, an overlap (a block sent twice is one), blocks that tell
    different sizes, bytes that are missing or too many. The digest is null then. A file without a block has no row.
    """
    rows = chunks.select("file", F.col("offset").cast("bigint").alias("offset"), F.try_to_binary("data", F.lit("base64")).alias("data"), F.col("size").cast("bigint").alias("size"))
    return rows.repartition("file").sortWithinPartitions("file", "offset").mapInArrow(_carry, CHECKED)


def _carry(batches):
    file, known = None, False
    held: list[tuple] = []

    def begin(name, size):
        nonlocal file, known, n, at, total, problem, digest
        file, known, n, at, total, problem, digest = name, True, 0, 0, size, None, hashlib.sha256()

    def end():
        last = problem or ("bytes are missing" if total is None or at < total else "too many bytes" if at > total else None)
        held.append((file, n, at, None if last else digest.hexdigest(), last))

    n = at = 0
    total = problem = digest = None
    for batch in batches:
        names, offsets, sizes, data = (batch.column(c) for c in ("file", "offset", "size", "data"))
        for i in range(batch.num_rows):
            name, offset, size = names[i].as_py(), offsets[i].as_py(), sizes[i].as_py()
            if not known or name != file:
                if known:
                    end()
                begin(name, size)
            n += 1
            if problem is None:
                block = data[i].as_buffer() if data[i].is_valid else None
                if block is None or offset is None:
                    problem = "not a block"
                elif size != total:
                    problem = "sizes differ"
                elif offset != at:
                    problem = "gap" if offset > at else "overlap"
                else:
                    digest.update(block)
                    at += len(block)
        if held:
            yield _checked(held)
            held = []
    if known:
        end()
        yield _checked(held)


def _checked(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[f.split(" ")[0] for f in CHECKED.split(", ")])
