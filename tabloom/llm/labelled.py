"""Bounded samples of labelled documents, for the classifiers that are trained here."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, slices

#: Characters of the texts that a classifier is trained on.
SAMPLE_CHARS = 1 << 26


def remainder(of: int) -> Column:
    """crc32 of the doc_id as text, modulo of; null without a doc_id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % of


def held_out(of: int, left: int) -> Column:
    return F.coalesce(remainder(of) == left, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, of: int, left: int, rows: int) -> DataFrame:
    """doc_id, text, chars, label of at most rows documents that are not held out, the first by a hash of doc_id.

    Of several labels of a doc_id the greatest counts, and of several texts the least; nulls and values but 0 and 1
    don't. Only this many ids are broadcast, whatever the tables hold.
    """
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("label")).filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(of, left))
    chosen = known.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    return texts.select("doc_id", "text", F.coalesce(F.char_length("text"), F.lit(0)).cast("bigint").alias("chars"), "label")


def gathered(rows: DataFrame, chars: int = SAMPLE_CHARS) -> pa.Table:
    """What was made of sample()'s rows, on the driver: as many rows, by the hash of doc_id, as have chars characters."""
    rows = cut(rows.withColumn("h", F.xxhash64("doc_id")), "sample")
    total, last = 0, None
    for h, n in sorted(tuple(r) for r in rows.select("h", "chars").collect()):  # two numbers for each row of the sample
        total += n
        if total > chars:
            rows = rows.filter(F.col("h") <= F.lit(last)) if last is not None else rows.limit(0)
            break
        last = h
    return rows.drop("h").toArrow().sort_by([("doc_id", "ascending")])


def with_scores(docs: DataFrame, of: int, left: int, score: Callable[[list[str | None]], list[float]], threshold: float) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out(of, left).alias("held_out"))

    def run(batches):
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score(batch.column("text").to_pylist()), pa.float64())], names=["doc_id", "held_out", "score"])

    return texts.mapInArrow(run, "doc_id bigint, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))
