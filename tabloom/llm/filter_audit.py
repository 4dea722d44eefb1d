"""Operator 13, audit of how filters interact, in every order they can be applied in.

Repeated texts are found in two steps. A counting Bloom filter is built over the texts' hashes: each task counts its own
in the filter's tiles, the tiles are merged, and a text with a counter below two is unique for sure. Only the others,
possible repeats, are shuffled, and grouped by their whole text for the least doc_id of each. A document then fails the
filter for copies if it is a possible repeat and not the first of its text; so no join meets a group of copies. What
each document fails is a mask of five bits, and all that is reported is a sum over masks.

The filter has COUNTERS counters for each row, of which a row takes TAKES; its tiles keep one bit for each counter (two
or more), 2 bytes a row. They are broadcast while they are few (counted), as are the hashes of possible repeats; beyond
that Spark shuffles slim rows, and texts with them.

Defined results: a null text is empty, and empty texts are equal; a null lang is the part ''; a document without a
doc_id has no label, is no copy and nothing is a copy of it; rows that repeat a doc_id and its text are no copies of each
other; of several labels of a doc_id the greatest counts; a very long text is read in pieces; other columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, narrow, slices, text_pieces

FILTERS = "ABCDE"
#: Counters of the filter for a row, and how many a row takes; counters of a tile.
COUNTERS, TAKES, TILE = 16, 4, 1 << 14
#: Tiles of 2 KB that are broadcast at most: 64 MB.
TILES = 1 << 15
#: Counters taken that a task counts at once.
SKETCHED = 1 << 22
WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 100, 80, 10
CAPITALS, SIGNS = bytes(range(65, 91)), b"#$%&*|"


def failures(text: str | None) -> int:
    """Bits 0 to 3: does the text fail filters A to D?"""
    words = capitals = points = signs = 0
    distinct: set[bytes] = set()
    for piece in text_pieces(text or ""):
        data = piece.encode("utf-8", "surrogatepass")
        own = data.split()  # at bytes 20 and 09 to 0D (hex), as for bytes Python knows no other white space
        words += len(own)
        distinct.update(own)
        points += len(piece)
        capitals += len(data) - len(data.translate(None, CAPITALS))
        signs += len(data) - len(data.translate(None, SIGNS))
    return (words < WORDS) | (100 * len(distinct) < DISTINCT_PERCENT * words) << 1 | (100 * capitals > CAPITAL_PERCENT * points) << 2 | (signs > 0) << 3


def _tile(tiles: int) -> Column:
    return F.pmod(F.shiftright("h", 32), F.lit(tiles)).cast("int")


def _slots() -> list[Column]:
    """The counters of a hash within its tile."""
    return [F.pmod(F.hash("h", F.lit(i)), F.lit(TILE)) for i in range(TAKES)]


def twice_taken(hashes: DataFrame, tiles: int) -> DataFrame:
    """tile, bits: of each tile of the merged filter, the counters of two or more, 64 in a number."""

    def count(batches):
        held: list[np.ndarray] = []

        def sketch():
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            own = keys // TILE
            starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            cuts = [*starts.tolist(), len(keys)]
            slots, more = (keys % TILE).astype("<i2"), n > 1
            ranges = [slice(i, j) for i, j in zip(cuts, cuts[1:])]
            once, twice = ([slots[r][more[r] == b].tobytes() for r in ranges] for b in (False, True))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(own[starts].astype(np.int32)), pa.array(once, pa.binary()), pa.array(twice, pa.binary())], names=["tile", "once", "twice"])

        for batch in batches:
            slots = np.sort(np.stack([batch.column(f"s{i}").to_numpy() for i in range(TAKES)], axis=1), axis=1)
            # A row takes a counter once, even if two of its own are the same.
            new = np.concatenate([np.ones((len(slots), 1), bool), slots[:, 1:] != slots[:, :-1]], axis=1)
            held.append((batch.column("tile").to_numpy().astype(np.int64)[:, None] * TILE + slots)[new])
            if sum(map(len, held)) > SKETCHED:
                yield sketch()
        if held:
            yield sketch()

    def merge(key, table):
        counters = np.zeros(TILE, np.int64)
        for times, c in ((1, "once"), (2, "twice")):
            counters += times * np.bincount(np.frombuffer(b"".join(table.column(c).to_pylist()), "<i2"), minlength=TILE)
        bits = np.packbits(counters >= 2, bitorder="little").view("<i8")
        return pa.table({"tile": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([bits.tolist()], pa.list_(pa.int64()))})

    taken = hashes.select(_tile(tiles).alias("tile"), *[s.alias(f"s{i}") for i, s in enumerate(_slots())])
    return taken.mapInArrow(count, "tile int, once binary, twice binary").groupBy("tile").applyInArrow(merge, "tile int, bits array<bigint>")


def possible_repeats(rows: DataFrame, n: int) -> DataFrame:
    """rows (n of them, with a column h) and possible: could another row have the same h? Never false if one has."""
    tiles = max(1, -(-n * COUNTERS // TILE))
    bits = cut(twice_taken(rows, tiles), "tiles")
    looked = rows.withColumn("_tile", _tile(tiles)).join(narrow(bits, tiles, TILES), F.col("_tile") == F.col("tile"))
    taken = [F.getbit(F.get("bits", F.shiftright(s, 6)), s.bitwiseAND(63)) == 1 for s in _slots()]
    return looked.select(*rows.columns, reduce(Column.__and__, taken).alias("possible"))


def masks(docs: DataFrame) -> DataFrame:
    """doc_id, lang, mask of every row: bit i tells whether it fails FILTERS[i]."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"))
    rows = rows.withColumn("h", F.xxhash64("text"))

    def run(batches):
        for batch in slices(batches):
            fails = [failures(t) for t in batch.column("text").to_pylist()]
            yield batch.select(["doc_id", "lang", "h"]).append_column("mask", pa.array(fails, pa.int32()))

    flagged = cut(rows.mapInArrow(run, "doc_id bigint, lang string, h bigint, mask int"), "flags")
    flagged = cut(possible_repeats(flagged, flagged.count()), "possible")
    again = F.col("possible") & F.col("doc_id").isNotNull()
    maybe = cut(flagged.filter(again).select("h").distinct(), "repeat-hashes")
    # The least id of each whole text; of a text's many rows one for each task is shuffled.
    texts = rows.filter("doc_id is not null").join(narrow(maybe, maybe.count()), "h", "left_semi")
    first = cut(texts.groupBy("h", "text").agg(F.min("doc_id").alias("first")).select(F.col("h").alias("_h"), "first"), "first-ids")
    later = flagged.filter(again).join(narrow(first, first.count()), (F.col("h") == F.col("_h")) & (F.col("doc_id") == F.col("first")), "left")
    later = later.select("doc_id", "lang", F.when(F.col("first").isNull(), F.col("mask").bitwiseOR(F.lit(16))).otherwise(F.col("mask")).alias("mask"))
    return flagged.filter(~again).select("doc_id", "lang", "mask").unionAll(later)


def mask_counts(masked: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents of each mask, and those of them with a label of 1."""
    one = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0))
    known = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(one("quality").alias("good"), one("toxic").alias("toxic")).filter("good + toxic > 0")
    marked = masked.filter("doc_id is not null").join(known, "doc_id", "left")
    # Rows without an id have no label: they would all meet in one task of the join.
    both = marked.select("lang", "mask", "good", "toxic").unionAll(masked.filter("doc_id is null").select("lang", "mask", F.lit(0).alias("good"), F.lit(0).alias("toxic")))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c)
    return both.groupBy(F.col("lang").alias("part"), "mask").agg(F.count("*").alias("n"), total("good"), total("toxic"))


def orders(spark: SparkSession) -> DataFrame:
    """What a mask means for each step of each order: mask, filter_order, step, letter, fate (kept, removed, redundant or gone), alone."""
    rows = []
    for order in map("".join, permutations(FILTERS)):
        for mask in range(1 << len(FILTERS)):
            out = False
            for step, letter in enumerate(order, 1):
                fails = bool(mask >> FILTERS.index(letter) & 1)
                fate = ("redundant" if fails else "gone") if out else ("removed" if fails else "kept")
                out = out or fails
                rows.append((mask, order, step, letter, fate, mask == 1 << FILTERS.index(letter)))
    return spark.createDataFrame(rows, "mask int, filter_order string, step int, letter string, fate string, alone boolean")


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, order and step; see the module for the defined cases."""
    counts = cut(mask_counts(masks(docs), labels), "mask-counts")
    meant = counts.join(F.broadcast(orders(docs.sparkSession)), "mask")  # 120 orders of 5 steps for 32 masks
    where = lambda c, fate: F.sum(F.when(F.col("fate") == fate, F.col(c)).otherwise(0))
    steps = meant.groupBy("part", "filter_order", "step", "letter").agg(
        where("n", "kept").alias("kept"),
        where("n", "removed").alias("removed"),
        where("n", "redundant").alias("redundant"),
        F.sum(F.when(F.col("alone"), F.col("n")).otherwise(0)).alias("unique_fails"),
        where("good", "removed").alias("good_lost"),
        where("toxic", "removed").alias("toxic_lost"),
    )
    return steps.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "letter"))).drop("letter")


def _oracle() -> str:
    fails = [
        "len(words) < 100",
        "100 * len(list_distinct(words)) < 80 * len(words)",
        "100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t)",
        "regexp_matches(t, '[#$%&*|]')",
        "first < doc_id",
    ]
    mask = " + ".join(f"coalesce(({f})::int, 0) * {1 << i}" for i, f in enumerate(fails))
    steps = ", ".join(f"('{''.join(o)}', {s}, {1 << FILTERS.index(o[s - 1])}, {sum(1 << FILTERS.index(x) for x in o[: s - 1])})" for o in permutations(FILTERS) for s in range(1, 6))
    return f"""
    WITH texts AS (
      SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents
    ), firsts AS (SELECT t, min(doc_id) AS first FROM texts GROUP BY t
    ), flags AS (
      SELECT doc_id, part, t, first, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS words FROM texts JOIN firsts USING (t)
    ), known AS (
      SELECT doc_id, coalesce(max((quality = 1)::int), 0) AS good, coalesce(max((toxic = 1)::int), 0) AS toxic FROM labels GROUP BY doc_id
    ), counts AS (
      SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
      FROM (SELECT doc_id, part, {mask} AS mask FROM flags) LEFT JOIN known USING (doc_id) GROUP BY part, mask
    ), steps(filter_order, step, own, earlier) AS (VALUES {steps}
    ), sums AS (
      SELECT part, filter_order, step, own,
        sum(CASE WHEN mask & (own | earlier) = 0 THEN n ELSE 0 END) AS kept,
        sum(CASE WHEN mask & own > 0 AND mask & earlier = 0 THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN mask & own > 0 AND mask & earlier > 0 THEN n ELSE 0 END) AS redundant,
        sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN mask & own > 0 AND mask & earlier = 0 THEN good ELSE 0 END) AS good_lost,
        sum(CASE WHEN mask & own > 0 AND mask & earlier = 0 THEN toxic ELSE 0 END) AS toxic_lost
      FROM counts CROSS JOIN steps GROUP BY part, filter_order, step, own
    )
    SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
      good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
    FROM sums"""


ORACLE = _oracle()
