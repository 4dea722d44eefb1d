"""Operator 12, packing into sequences by best-two-fit.

A sequence is filled greedily, longest piece first; then its smallest piece is replaced by two unpacked pieces whose sum
fits the expanded gap more tightly, if there are any. Pieces of one length are alike to this rule, so it is applied to
the histogram of lengths, which has one number per length up to the capacity, whatever the table's size. A filled
sequence is repeated as long as the same choices would be made again; every repetition ends with a length running short,
so there are at most capacity * (ln(capacity) + 3) kinds of sequences.

Pieces are made, and numbered among the pieces of their length, where their document is encoded. The numbers of a task
are moved by the pieces of that length in earlier tasks, and the number tells the sequence and the place in it.

Defined results: a null or empty text is its end id alone; only documents longer than the capacity are cut, at its
multiples; a null doc_id is passed on; repeated rows are packed each; a very long text is encoded in pieces of text;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, narrow, slices
from .token_files import check_chunkable, encode_to_bytes

CAPACITY = 4096
PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, ids binary, part int, nth bigint"
#: Bits of a number among the pieces of one length, below the length in a key.
NTH_BITS = 44


def _filled(left: np.ndarray, capacity: int) -> tuple[Counter, Counter]:
    """The next sequence: how often each length is in it, and how many of each length the choice of it takes to be there."""
    lengths = np.arange(capacity + 1)
    longest = np.maximum.accumulate(np.where(left > 0, lengths, 0))  # the longest piece of at most so many tokens
    filled: Counter = Counter()
    gap, most = capacity, capacity
    while gap and most and (x := int(longest[min(gap, most)])):
        filled[x] = min(int(left[x]), gap // x)
        gap -= x * filled[x]
        most = x - 1
    needed = Counter(filled)
    if gap and sum(filled.values()) > 1:
        small = min(filled)
        rest = left.copy()
        for x, k in filled.items():
            rest[x] -= k
        room = gap + small
        longest = np.maximum.accumulate(np.where(rest > 0, lengths, 0))
        first = np.flatnonzero(rest[: room + 1])
        first = first[first < room]
        second = longest[np.minimum(room - first, first)]
        alone = (second == first) & (rest[first] < 2)  # two of a length that has one: the next shorter one
        second = np.where(alone, longest[np.maximum(first - 1, 0)], second)
        total = np.where(second > 0, first + second, 0)
        if len(total) and total.max() > small:
            i = int(total.argmax())
            filled[small] -= 1
            filled += Counter()
            for x in (int(first[i]), int(second[i])):
                filled[x] += 1
                needed[x] += 1
    return filled, needed


def best_two_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """(pieces of each length, number of such sequences) that pack so many pieces of each length."""
    left = np.zeros(capacity + 1, np.int64)
    for x, n in counts.items():
        left[x] = n
    out = []
    while left.any():
        filled, needed = _filled(left, capacity)
        times = 1 + min((int(left[x]) - needed[x]) // k for x, k in filled.items())
        for x, k in filled.items():
            left[x] -= times * k
        out.append((dict(filled), times))
    return out


@dataclass
class Places:
    """Where the nth piece of a length lies: runs of pieces by the key of their first."""

    keys: np.ndarray
    each: np.ndarray  # pieces of the length in a sequence
    sequence: np.ndarray  # the first sequence
    offset: np.ndarray  # of the length's first piece in it

    @classmethod
    def of(cls, sequences: list[tuple[dict[int, int], int]]) -> Places:
        seen: Counter = Counter()
        rows, first = [], 0
        for filled, times in sequences:
            offset = 0
            for x in sorted(filled, reverse=True):
                rows.append(((x << NTH_BITS) + seen[x], filled[x], first, offset))
                seen[x] += times * filled[x]
                offset += x * filled[x]
            first += times
        return cls(*np.array(sorted(rows), np.int64).reshape(-1, 4).T)

    def find(self, lengths: np.ndarray, nth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of each piece."""
        key = (lengths << NTH_BITS) + nth
        i = np.searchsorted(self.keys, key, "right") - 1
        sequence, slot = np.divmod(key - self.keys[i], self.each[i])
        return self.sequence[i] + sequence, self.offset[i] + slot * lengths


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, ids (little-endian 32 bits; null unless kept), and part and nth.

    nth counts the pieces of a length within the task, part. Only a table written from this is consistent in them.
    """
    check_chunkable(path)
    end = struct.pack("<I", end_id)

    def run(batches):
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for some in slices(batches, 512):
            rows = []
            for doc, ids in zip(some.column("doc_id").to_pylist(), encode_to_bytes(some.column("text").to_pylist(), path), strict=True):
                ids += end
                for i, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    rows.append((doc, i, at // 4, len(own) // 4, zlib.crc32(own), own if keep_ids else None))
            columns = list(zip(*rows, strict=True))
            lengths = np.array(columns[3], np.int64)
            order = np.argsort(lengths, kind="stable")
            runs = np.searchsorted(lengths[order], lengths[order])
            nth = np.empty(len(rows), np.int64)
            nth[order] = np.arange(len(rows)) - runs
            nth += seen[lengths]
            seen += np.bincount(lengths, minlength=capacity + 1)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)] + [pa.array(np.full(len(rows), part, np.int32)), pa.array(nth)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids", "part", "nth"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECE)


def packed(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """Every piece of docs with its sequence_id and its offset there."""
    made = cut(pieces(docs, path, capacity, end_id, keep_ids), "pieces")
    own = cut(made.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-lengths")
    histogram = {r["length"]: r["n"] for r in own.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row for each length up to the capacity
    places = Places.of(best_two_fit(histogram, capacity))
    # A row for each task and length: a window holds as many rows as there are tasks, however many pieces have the length.
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    moved = own.select(F.col("part").alias("_part"), F.col("length").alias("_length"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    numbered = made.join(narrow(moved, own.count()), (F.col("part") == F.col("_part")) & (F.col("length") == F.col("_length")))
    numbered = numbered.select("doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids, (F.col("nth") + F.col("_before")).alias("nth"))

    def run(batches):
        for batch in batches:
            sequence, offset = places.find(batch.column("length").to_numpy(), batch.column("nth").to_numpy())
            yield batch.drop_columns(["nth"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    kept = "ids binary, " if keep_ids else ""
    return numbered.mapInArrow(run, f"doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, {kept}sequence_id bigint, offset bigint")


def sequences(placed: DataFrame) -> DataFrame:
    """sequence_id, n_pieces, length, ids of each sequence, from packed(keep_ids=True); none is longer than the capacity."""
    own = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.count("*").alias("n_pieces"), F.sum("length").alias("length"), F.expr("cast('' as binary)").alias("none"), own.alias("own")).select(
        "sequence_id", "n_pieces", "length", F.aggregate("own", F.col("none"), lambda whole, x: F.concat(whole, x["ids"])).alias("ids")
    )
