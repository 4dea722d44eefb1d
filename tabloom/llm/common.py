"""What the operators of this subpackage share: the shared folder, size checks and text pieces."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of 16 bytes or so that may be broadcast after they were counted: 8 MB at most.
BROADCAST_ROWS = 500_000
#: Characters of a text that are held as a list of words at once.
PIECE_CHARS = 1 << 20

_own_dir: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a temporary one is made, in local mode only."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if there:
        return there.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    key = context.applicationId
    if key not in _own_dir:
        _own_dir[key] = "file://" + tempfile.mkdtemp(prefix="tabloom-")
        context.setCheckpointDir(_own_dir[key])
    return _own_dir[key]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tabloom/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it: lineage ends there and lost executors cost nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def narrow(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark df for broadcast if the counted rows are few; beyond that Spark shuffles as usual."""
    return F.broadcast(df) if rows <= limit else df


def give_back() -> None:
    """Return what Python has freed to the system, as a driver lives on after a training and would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def text_pieces(text: str | None, size: int = PIECE_CHARS) -> Iterator[str]:
    """The text in pieces of about size characters, cut only before white space; none is lost.

    A run of more than size characters without white space is a piece as it is.
    """
    if text is None:
        return
    if len(text) <= size:
        yield text
        return
    at = 0
    cut_here = re.compile(r"[ \t-\r\xa0\u2028\u2029\u3000]")
    while at < len(text):
        m = cut_here.search(text, at + size) if at + size < len(text) else None
        end = m.start() if m else len(text)
        yield text[at:end]
        at = end


def slices(batches, rows: int = 1024, size: int = 1 << 23):
    """Arrow batches in slices of few rows and about size bytes, so that a task holds few texts as Python strings."""
    for batch in batches:
        some = max(1, min(rows, batch.num_rows * size // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, some):
            yield batch.slice(at, some)
