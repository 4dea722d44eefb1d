"""The audit as a stream: versions arrive, missing pairs are compared and committed, each once and in order.

Every micro-batch is one idempotent commit: pairs that are done are left out before anything is compared, so a batch
that runs again after a failure writes nothing twice. A version that arrives again is left out; the others are paired
with their neighbours among all versions known from the checkpoint on. Versions below the checkpoint that no pair holds
are inconsistent, not late: they end the stream with an error, as dropping them would lose changes.

A pair is compared only if the contents of both its versions are there: a version is loaded if it has cells, or a row
among the digests, as an empty workbook has. Other pairs are left open, with an error in the trail, and the stream tries
them again with its next batch. A checkpoint moves over pairs that are done, from where it stands, and never back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.cells import address
from ..functions.text import sqlite_integer
from ..operators.diff import snapshot_diff
from ..operators.sequences import consecutive_pairs
from ..plans.catalog import Inconsistent
from ..plans.trail import KEYS, Trail, authoritative

VERSIONS = "workbook_id bigint, version_id string"
#: A table of CELLS, or a function from versions to their CELLS and digests (columns of both, one of them null).
Contents = DataFrame | Callable[[DataFrame], DataFrame]
CELLS = "workbook_id bigint, version_id string, sheet string, row bigint, column bigint, text string, key string"


def version_pairs(versions: DataFrame) -> DataFrame:
    """workbook_id, previous_id, current_id of consecutive versions."""
    numbered = versions.select("workbook_id", F.struct(sqlite_integer(F.col("version_id")).alias("n"), "version_id").alias("v")).distinct()
    return consecutive_pairs(numbered, ["workbook_id"], "v").select("workbook_id", F.col("previous.version_id").alias("previous_id"), F.col("current.version_id").alias("current_id"))


def missing_pairs(versions: DataFrame, trail: Trail) -> DataFrame:
    """workbook_id, previous_id, current_id of consecutive versions that are not done."""
    return version_pairs(versions).join(authoritative(trail.read("pair")).select(*KEYS["pair"]), KEYS["pair"], "left_anti")


def pending(versions: DataFrame, trail: Trail) -> DataFrame:
    """workbook_id, versions, pending: how many versions a workbook has, and how many of its pairs are not done; with those that have none."""
    open_ = missing_pairs(versions, trail).groupBy("workbook_id").agg(F.count("*").alias("pending"))
    known = versions.groupBy("workbook_id").agg(F.count_distinct("version_id").alias("versions"))
    return known.join(open_, "workbook_id", "left").withColumn("pending", F.coalesce("pending", F.lit(0)))


def content_digests(cells: DataFrame) -> DataFrame:
    """workbook_id, version_id, digest: 64 hex digits of a version's cells, in any order, summed where they lie."""
    part = lambda seed: F.lpad(F.lower(F.hex(F.bit_xor(F.xxhash64(F.lit(seed), "sheet", "row", "column", "key")))), 16, "0")
    return cells.groupBy("workbook_id", "version_id").agg(F.concat(*[part(seed) for seed in range(4)]).alias("digest"))


def compare_pairs(pairs: DataFrame, cells: DataFrame) -> DataFrame:
    """Changes of all pairs in one plan: the pair is part of the join's key."""
    side = lambda c: pairs.join(cells.withColumnRenamed("version_id", c), ["workbook_id", c])
    by = KEYS["pair"]
    changes = snapshot_diff(side("previous_id"), side("current_id"), by)
    return changes.select(*by, "sheet", address(F.col("row"), F.col("column")).alias("address"), "change_type", "previous_value", "new_value")


def content_of(pairs: DataFrame, cells: DataFrame, digests: DataFrame | None = None) -> DataFrame:
    """workbook_id, version_id, digest of the pairs' versions whose contents are there."""
    own = pairs.select("workbook_id", F.explode(F.array("previous_id", "current_id")).alias("version_id")).distinct()
    if digests is not None:
        return digests.filter("digest is not null").select("workbook_id", "version_id", "digest").join(own, ["workbook_id", "version_id"], "left_semi")
    return content_digests(cells.join(own, ["workbook_id", "version_id"], "left_semi"))


def with_content(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """pairs with digest, of the current version, and ready: are both contents there?"""
    side = lambda c, d: known.select("workbook_id", F.col("version_id").alias(c), F.col("digest").alias(d))
    both = pairs.join(side("current_id", "digest"), ["workbook_id", "current_id"], "left").join(side("previous_id", "_before"), ["workbook_id", "previous_id"], "left")
    return both.withColumn("ready", F.col("digest").isNotNull() & F.col("_before").isNotNull()).drop("_before")


def reached(versions: DataFrame, trail: Trail) -> DataFrame:
    """workbook_id, version_id: the end of the done pairs that follow each other from the checkpoint, or from the first version."""
    number = lambda c: sqlite_integer(F.col(c))
    pairs = version_pairs(versions).withColumn("_from", number("previous_id"))
    stored = trail.read("checkpoint").select("workbook_id", number("version_id").alias("_at"))
    pairs = pairs.join(stored, "workbook_id", "left").filter(F.col("_at").isNull() | (F.col("_from") >= F.col("_at")))
    done = authoritative(trail.read("pair")).select(*KEYS["pair"]).withColumn("_done", F.lit(True))
    pairs = pairs.join(done, KEYS["pair"], "left")
    # A listing that doesn't hold the checkpoint's version leaves a gap after it.
    opened = pairs.groupBy("workbook_id").agg(F.min(F.when(F.col("_done").isNull(), F.col("_from"))).alias("_open"), F.min("_from").alias("_first"), F.max("_at").alias("_stands"))
    opened = opened.filter(F.col("_stands").isNull() | (F.col("_first") == F.col("_stands"))).select("workbook_id", "_open")
    return pairs.join(opened, "workbook_id").filter(F.col("_open").isNull() | (F.col("_from") < F.col("_open"))).groupBy("workbook_id").agg(F.max_by("current_id", number("current_id")).alias("version_id"))


def audit(versions: DataFrame, cells: Contents, trail: Trail, run_id: int | None = None, move_checkpoint: bool = True, digests: DataFrame | None = None) -> DataFrame:
    """Compare and commit what is missing; gives the pairs that were written. Without move_checkpoint: an interval only.

    cells: a table, or what reads the cells of versions (workbook_id, version_id) with the digests of those that are there.
    digests (workbook_id, version_id, digest): of the versions that are loaded, by their files; without it, of their
    cells. What is given back can be read until the next audit.
    """
    trail.discard_staging()
    return _audit(trail.stage(versions.select("workbook_id", "version_id")), cells, trail, run_id, move_checkpoint, digests)


def _audit(versions: DataFrame, cells: Contents, trail: Trail, run_id: int | None, move_checkpoint: bool = True, digests: DataFrame | None = None) -> DataFrame:
    """audit() of versions that no table of the trail is read for."""
    every = trail.stage(missing_pairs(versions, trail))
    if callable(cells):  # read now, once, for the versions of missing pairs only
        own = every.select("workbook_id", F.explode(F.array("previous_id", "current_id")).alias("version_id")).distinct()
        read = trail.stage(cells(own))
        cells, digests = read.filter("sheet is not null"), read.filter("digest is not null")
    every = trail.stage(with_content(every, content_of(every, cells, digests)))
    waiting = every.filter(~F.col("ready"))
    pairs = every.filter("ready").drop("ready")
    changes = trail.stage(compare_pairs(pairs, cells))
    counts = changes.groupBy(*KEYS["pair"]).agg(F.count("*").alias("changes"))
    rows = pairs.join(counts, KEYS["pair"], "left").withColumn("changes", F.coalesce("changes", F.lit(0)))
    rows = rows.withColumns({"run_id": F.lit(run_id).cast("bigint"), "status": F.when(F.col("changes") > 0, "PROCESSADA").otherwise("SEM_ALTERACOES"), "pair_id": F.xxhash64(*KEYS["pair"])})
    written = trail.commit(rows, changes)
    if waiting.head(1):
        message = F.concat(F.lit("no content of both versions: "), "previous_id", F.lit(" -> "), "current_id")
        trail.append("error", waiting.select(F.lit(run_id).cast("bigint").alias("run_id"), "workbook_id", F.lit("content").alias("stage"), message.alias("message"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("at")))
    if move_checkpoint:
        trail.move_checkpoint(trail.stage(reached(versions, trail)))
    return written


def start(versions: DataFrame, cells: Contents, trail: Trail, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Run the audit on a stream of versions; cells is the table that holds their contents, or what reads them."""

    def batch(arrived: DataFrame, epoch: int) -> None:
        checkpoints = trail.read("checkpoint").select("workbook_id", "version_id")
        before = checkpoints.select("workbook_id", sqlite_integer(F.col("version_id")).alias("at"))
        done = authoritative(trail.read("pair")).select("workbook_id", F.explode(F.array("previous_id", "current_id")).alias("version_id")).unionByName(checkpoints).distinct()
        # What came before and is in no pair yet is tried again.
        waiting = trail.read("pending_version")
        new = arrived.select("workbook_id", "version_id").unionByName(waiting).distinct().join(done, ["workbook_id", "version_id"], "left_anti")
        if not new.head(1):
            return
        number = sqlite_integer(F.col("version_id"))
        if new.join(before, "workbook_id").filter(number < F.col("at")).head(1):
            raise Inconsistent("a version arrived below the checkpoint")
        # From the checkpoint on: pairs of an interval may lie beyond it.
        known = done.join(new.select("workbook_id").distinct(), "workbook_id", "left_semi").join(before, "workbook_id", "left").filter(F.col("at").isNull() | (number >= F.col("at"))).select("workbook_id", "version_id")
        had = bool(waiting.head(1))
        trail.discard_staging()
        every = trail.stage(new.unionByName(known))
        _audit(every, cells, trail, epoch)
        # A workbook's only version so far, and versions without content, are in no pair.
        paired = authoritative(trail.read("pair")).select("workbook_id", F.explode(F.array("previous_id", "current_id")).alias("version_id"))
        left = every.join(paired, ["workbook_id", "version_id"], "left_anti")
        if had or left.head(1):
            trail.replace("pending_version", trail.stage(left))

    writer = versions.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
