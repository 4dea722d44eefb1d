"""The trail as tables: schemas, idempotent commits, constraints, backup, restore and deletion.

Parquet has no transactions over several tables. A commit therefore writes a pair's changes first, then the pair, and
the checkpoint last, and readers join changes with committed pairs; a commit that broke off leaves nothing that is read.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables with their columns, keys and permitted values.
SCHEMAS = {
    "workbook": "workbook_id bigint, site_id string, drive_id string, item_id string, name string, path string, created_at string",
    "checkpoint": "workbook_id bigint, version_id string, version_label string, run_id bigint, updated_at string",
    "run": "run_id bigint, workbook_id bigint, code string, status string, mode string, started_at string, finished_at string, processed bigint, changes bigint, message string",
    "pair": "pair_id bigint, workbook_id bigint, run_id bigint, previous_id string, current_id string, status string, digest string, changes bigint",
    "change": "workbook_id bigint, previous_id string, current_id string, sheet string, address string, change_type string, previous_value string, new_value string",
    "error": "run_id bigint, workbook_id bigint, stage string, message string, at string",
    "version_catalog": "identity string, version_id string, label string, modified_at string, author string, is_current boolean, pos bigint",
    "version_catalog_state": "identity string, last_current_id string, versions bigint, status string",
    "runtime_profile": "identity string, slots bigint, prefetch bigint, rate double, confidence string",
    "slot_preference": "identity string, slots bigint",
    "pending_version": "workbook_id bigint, version_id string",
    "runtime_benchmark": "identity string, slots bigint, rate double, prefetch bigint, kind string, completed boolean, comparable boolean, tasks bigint",
}
KEYS = {"workbook": ["site_id", "drive_id", "item_id"], "checkpoint": ["workbook_id"], "run": ["code"], "pair": ["workbook_id", "previous_id", "current_id"], "change": ["workbook_id", "previous_id", "current_id", "sheet", "address"], "version_catalog": ["identity", "version_id"], "version_catalog_state": ["identity"], "runtime_profile": ["identity"], "slot_preference": ["identity"]}
FINAL = ("PROCESSADA", "SEM_ALTERACOES")
CHANGE_TYPES = ("ADD", "DEL", "MOD")


def duplicates(rows: DataFrame, key: list[str]) -> DataFrame:
    """Groups of a key with more than one row."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def orphans(children: DataFrame, child_key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    return children.join(parents.select(F.col(parent_key).alias("_parent")).distinct(), children[child_key] == F.col("_parent"), "left_anti")


def inconsistent(children: DataFrame, parents: DataFrame, on: str, field: str) -> DataFrame:
    """Children whose field differs from their parent's."""
    p = parents.select(F.col(on).alias("_on"), F.col(field).alias("_field"))
    return children.join(p, children[on] == F.col("_on")).filter(F.col(field) != F.col("_field")).drop("_on", "_field")


def remap(rows: DataFrame, key: str, start: int) -> DataFrame:
    """old_id, new_id: ids after start, in the order of the old ones.

    Numbers come from counts per range of ids, so no task holds all rows.
    """
    from ..operators.sequences import sheets

    return sheets(rows.select(F.col(key).alias("old_id")).distinct(), "old_id", 1).select("old_id", (F.col("seq") + start).alias("new_id"))


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of new, and those of old that new has no key of."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def utc_text(at: dt.datetime) -> str:
    """A time in UTC, to the microsecond, with a Z."""
    return at.astimezone(dt.timezone.utc).isoformat(timespec="microseconds").replace("+00:00", "Z")


def run_code(at: dt.datetime) -> str:
    return f"AUD-{at.astimezone(dt.timezone.utc):%Y%m%dT%H%M%SZ}-{uuid.uuid4().hex[:8].upper()}"


def authoritative(pair: DataFrame) -> DataFrame:
    """Pairs that are done: a final status and a digest of 64 digits that is not all zeros. They are never written again."""
    return pair.filter(F.col("status").isin(*FINAL) & F.col("digest").rlike("^(?!0{64})[0-9a-fA-F]{64}$"))


class Trail:
    """The tables under a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def initialise(self) -> None:
        """Make the tables that are missing; those with rows stay."""
        for name, schema in SCHEMAS.items():
            (path, fs), (old, _) = self._path(name), self._path(f"{name}.old")
            if not fs.exists(path) and fs.exists(old):
                fs.rename(old, path)
            elif not fs.exists(path):
                self.spark.createDataFrame([], schema).write.parquet(f"{self.folder}/{name}")

    def read(self, name: str) -> DataFrame:
        """A table; columns that an older version lacks are null. Where a replacement broke off, what was there before."""
        path, fs = self._path(name)
        there = name if fs.exists(path) else f"{name}.old"
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.folder}/{there}")

    def append(self, name: str, rows: DataFrame) -> None:
        self._check(name, rows)
        self._typed(name, rows).write.mode("append").parquet(f"{self.folder}/{name}")

    def replace(self, name: str, rows: DataFrame) -> None:
        """Write beside the table, then put it in its place; a failure before that keeps the old one."""
        staged = f"{name}.next"
        self._typed(name, rows).write.mode("overwrite").parquet(f"{self.folder}/{staged}")
        (new, fs), (old, _) = self._path(staged), self._path(name)
        gone, _ = self._path(f"{name}.old")
        if fs.exists(old):
            fs.delete(gone, True)
            fs.rename(old, gone)
        # Between the two renames readers find the old table, see read().
        fs.rename(new, old)
        fs.delete(gone, True)

    def stage(self, rows: DataFrame) -> DataFrame:
        """Rows as a table of their own in the shared folder: what is written to the trail then doesn't change them."""
        at = f"{self.folder}/staging/{uuid.uuid4().hex}"
        rows.write.parquet(at)
        return self.spark.read.schema(rows.schema).parquet(at)

    def discard_staging(self) -> None:
        """Drop what was staged, by an audit that broke off or by one whose result is no longer needed."""
        path, fs = self._path("staging")
        fs.delete(path, True)

    def _typed(self, name: str, rows: DataFrame) -> DataFrame:
        from pyspark.sql.types import _parse_datatype_string

        fields = _parse_datatype_string(SCHEMAS[name]).fields
        return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])

    def _check(self, name: str, rows: DataFrame) -> None:
        """What the tables' constraints ask for, on the rows to be written."""
        if name in KEYS and duplicates(rows, KEYS[name]).head(1):
            raise ValueError(f"{name}: rows share {', '.join(KEYS[name])}")
        if name == "change" and rows.filter(~F.col("change_type").isin(*CHANGE_TYPES)).head(1):
            raise ValueError("change: unknown change_type")

    def changes(self) -> DataFrame:
        """Changes of committed pairs."""
        return self.read("change").join(authoritative(self.read("pair")).select(*KEYS["pair"]), KEYS["pair"], "left_semi")

    def commit(self, pairs: DataFrame, changes: DataFrame, checkpoint: DataFrame | None = None) -> DataFrame:
        """Write pairs that are not done yet with their changes, then the checkpoint. Gives the pairs that were written."""
        done = authoritative(self.read("pair")).select(*KEYS["pair"])
        new = self.stage(pairs.join(done, KEYS["pair"], "left_anti"))
        partial = self.read("change").join(new.select(*KEYS["pair"]), KEYS["pair"], "left_semi")
        if partial.head(1):  # what a broken commit left
            self.replace("change", self.read("change").join(new.select(*KEYS["pair"]), KEYS["pair"], "left_anti"))
        if self.read("pair").join(new.select(*KEYS["pair"]), KEYS["pair"], "left_semi").head(1):  # begun, not done
            self.replace("pair", self.read("pair").join(new.select(*KEYS["pair"]), KEYS["pair"], "left_anti"))
        self.append("change", self.stage(changes).join(new.select(*KEYS["pair"]), KEYS["pair"], "left_semi"))
        self.append("pair", new)
        if checkpoint is not None:
            self.move_checkpoint(checkpoint)
        return new

    def move_checkpoint(self, to: DataFrame) -> None:
        """Write the checkpoints that are beyond the stored ones in numeric order; none is moved back."""
        from ..functions.text import sqlite_integer

        number = sqlite_integer(F.col("version_id"))
        stored = self.read("checkpoint").select("workbook_id", number.alias("_at"))
        ahead = to.join(stored, "workbook_id", "left").filter(F.col("_at").isNull() | (number > F.col("_at"))).drop("_at")
        if ahead.head(1):
            self.replace("checkpoint", upsert(self.read("checkpoint"), self._typed("checkpoint", ahead), ["workbook_id"]))

    def integrity(self) -> DataFrame:
        """table, problem, n: orphans and duplicate keys; no rows if all is well."""
        out = []
        books = self.read("workbook")
        for name in ("checkpoint", "run", "pair", "change", "error"):
            out.append(orphans(self.read(name), "workbook_id", books, "workbook_id").agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), F.lit("orphans").alias("problem"), "n"))
        for name, key in KEYS.items():
            out.append(duplicates(self.read(name), key).agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), F.lit("duplicates").alias("problem"), "n"))
        found = out[0]
        for x in out[1:]:
            found = found.unionByName(x)
        return found.filter("n > 0")

    def backup(self, to: str, workbook_id: int | None = None) -> dict:
        """Copy the tables (or the rows of one workbook), with a manifest of counts and digests."""
        manifest = {}
        for name, schema in SCHEMAS.items():
            rows = self.read(name)
            if workbook_id is not None:
                rows = rows.filter(F.col("workbook_id") == workbook_id) if "workbook_id" in schema else rows.limit(0)
            rows.write.parquet(f"{to}/{name}")
            manifest[name] = self._digest(self.spark.read.schema(schema).parquet(f"{to}/{name}"))
        self.spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.text(f"{to}/_manifest")
        return manifest

    @staticmethod
    def _digest(rows: DataFrame) -> list:
        n, total = rows.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)")), F.lit(0))).head()
        return [n, str(int(total))]

    def verify(self, at: str) -> None:
        manifest = json.loads(self.spark.read.text(f"{at}/_manifest").head()[0])
        if set(SCHEMAS) - set(manifest):
            raise ValueError("the backup lacks tables")
        for name, schema in SCHEMAS.items():
            if self._digest(self.spark.read.schema(schema).parquet(f"{at}/{name}")) != manifest[name]:
                raise ValueError(f"{name}: the backup is damaged")

    def restore(self, at: str) -> str:
        """All tables from a backup that verifies. Gives the safety copy made before, which is put back if this fails."""
        self.verify(at)
        safety = f"{self.folder}/safety/{uuid.uuid4().hex}"
        self.backup(safety)
        try:
            self._put_back(at)
        except Exception:
            self._put_back(safety)
            raise
        return safety

    def _put_back(self, at: str) -> None:
        for name, schema in SCHEMAS.items():
            self.replace(name, self.spark.read.schema(schema).parquet(f"{at}/{name}"))

    def restore_workbook(self, at: str, replace: bool = False) -> None:
        """One workbook's rows from a backup, under new ids; without replace an equal identity is refused."""
        self.verify(at)
        saved = {n: self.spark.read.schema(s).parquet(f"{at}/{n}") for n, s in SCHEMAS.items()}
        here = self.stage(self.read("workbook").join(saved["workbook"], KEYS["workbook"], "left_semi").select("workbook_id"))
        if here.head(1):
            if not replace:
                raise ValueError("the workbook is there already")
            self.delete_all(here)
        new = {}
        for table, key in (("workbook", "workbook_id"), ("run", "run_id"), ("pair", "pair_id")):
            top = self.read(table).agg(F.coalesce(F.max(key), F.lit(0))).head()[0]
            new[key] = remap(saved[table], key, top)
        for name in ("workbook", "run", "pair", "change", "error", "checkpoint"):
            rows = saved[name]
            for key, ids in new.items():
                if key in rows.columns:
                    rows = rows.join(ids, F.col(key) == F.col("old_id"), "left").withColumn(key, F.col("new_id")).drop("old_id", "new_id")
            self.append(name, rows)

    def delete(self, workbook_id: int) -> None:
        self.delete_all(self.spark.createDataFrame([(workbook_id,)], "workbook_id bigint"))

    def delete_all(self, workbooks: DataFrame) -> None:
        """Children first."""
        for name in ("change", "error", "pair", "checkpoint", "run", "workbook"):
            self.replace(name, self.read(name).join(workbooks.select("workbook_id"), "workbook_id", "left_anti"))

    def open_run(self, workbook_id: int, mode: str = "incremental", now: dt.datetime | None = None) -> int:
        """A new run in progress; gives its id."""
        now = now or dt.datetime.now(dt.timezone.utc)
        run_id = self.read("run").agg(F.coalesce(F.max("run_id"), F.lit(0))).head()[0] + 1
        row = (run_id, workbook_id, run_code(now), "EM_ANDAMENTO", mode, utc_text(now), 0, 0)
        self.append("run", self.spark.createDataFrame([row], "run_id bigint, workbook_id bigint, code string, status string, mode string, started_at string, processed bigint, changes bigint"))
        return run_id

    def finish_run(self, run_id: int, status: str = "CONCLUIDA", message: str | None = None, now: dt.datetime | None = None) -> None:
        """Close a run with the counts of its pairs."""
        per = self.read("pair").filter(F.col("run_id") == run_id).agg(F.count("*").alias("p"), F.coalesce(F.sum("changes"), F.lit(0)).alias("c")).head()
        mine = F.col("run_id") == run_id
        new = {"status": F.lit(status), "finished_at": F.lit(utc_text(now or dt.datetime.now(dt.timezone.utc))), "processed": F.lit(per["p"]), "changes": F.lit(per["c"]), "message": F.lit(message)}
        self.replace("run", self.read("run").withColumns({c: F.when(mine, v).otherwise(F.col(c)) for c, v in new.items()}))

    def fail_run(self, run_id: int, stage: str, message: str, now: dt.datetime | None = None) -> None:
        """Record an error and close its run; checkpoint and pairs stay, so the next run goes on from there."""
        now = now or dt.datetime.now(dt.timezone.utc)
        book = self.read("run").filter(F.col("run_id") == run_id).select("workbook_id").head()[0]
        self.append("error", self.spark.createDataFrame([(run_id, book, stage, message, utc_text(now))], SCHEMAS["error"]))
        self.finish_run(run_id, "FALHA", message, now)

    def listing(self) -> DataFrame:
        """Workbooks with their pairs, changes, checkpoint and last run: summed before they are joined."""
        per = lambda name, agg: self.read(name).groupBy("workbook_id").agg(agg)
        out = self.read("workbook")
        for x in (per("pair", F.count("*").alias("pairs")), per("change", F.count("*").alias("changes")), per("run", F.max("finished_at").alias("last_run")), self.read("checkpoint").select("workbook_id", "version_id")):
            out = out.join(x, "workbook_id", "left")
        return out.withColumns({"pairs": F.coalesce("pairs", F.lit(0)), "changes": F.coalesce("changes", F.lit(0))})
