"""The catalog of versions as it is stored: kept up to date from the source, flagged while it can't be trusted.

What is known is used only with the status VALID and if it is what the state says. If the source went back, or what came
since doesn't fit, the catalog is flagged before all is read again: should that fail too, the next synchronisation reads
all, whatever is stored. Only a listing that is valid is ever stored, in the place of the one before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.sequences import running_total
from .catalog import Inconsistent, merge_delta
from .trail import Trail, upsert

#: The states of a catalog.
VALID, FLAGGED = "VALID", "NEEDS_RECONCILIATION"
#: What a source tells of versions; other columns of the catalog's table may be there too.
VERSIONS = "version_id bigint, label string, is_current boolean"


def problem(versions: DataFrame) -> str | None:
    """Why a listing can't be a workbook's history; None if it can."""
    v = F.col("version_id")
    current = F.coalesce(F.col("is_current"), F.lit(False))
    n, bad, ids, labels, currents, last, last_current = versions.agg(
        F.count("*"), F.count_if(v.isNull() | F.col("label").isNull()), F.count_distinct(v), F.count_distinct("label"), F.count_if(current), F.max(v), F.max(F.when(current, v))
    ).head()
    if not n:
        return "there are no versions"
    if bad:
        return "a version has no number or label"
    if ids < n:
        return "two versions have one id"
    if labels < n:
        return "two versions have one label"
    if currents != 1 or last != last_current:
        return "the current version is not the last one alone"
    return None


class StoredCatalog:
    def __init__(self, trail: Trail):
        self.trail = trail

    def load(self, identity: str) -> tuple[DataFrame, dict | None]:
        """The stored versions (VERSIONS and what else is stored), and the state, of a workbook."""
        mine = F.col("identity") == identity
        rows = self.trail.read("version_catalog").filter(mine).drop("identity", "pos").withColumn("version_id", F.col("version_id").try_cast("bigint"))
        state = self.trail.read("version_catalog_state").filter(mine).head()
        return rows, None if state is None else state.asDict()

    def _state(self, identity: str, last: str | None, n: int, status: str) -> None:
        row = self.trail.spark.createDataFrame([(identity, last, n, status)], "identity string, last_current_id string, versions bigint, status string")
        self.trail.replace("version_catalog_state", self.trail.stage(upsert(self.trail.read("version_catalog_state"), row, ["identity"])))

    def _store(self, identity: str, versions: DataFrame) -> DataFrame:
        """Put a valid listing in the place of what is stored; the state comes last."""
        placed = running_total(versions, [], ["version_id"], F.lit(1).cast("bigint"), "pos").withColumn("identity", F.lit(identity)).withColumn("version_id", F.col("version_id").cast("string"))
        names = self.trail.read("version_catalog").columns
        placed = placed.select(*[(F.col(c) if c in placed.columns else F.lit(None).cast("string")).alias(c) for c in names])
        others = self.trail.read("version_catalog").filter(~F.col("identity").eqNullSafe(F.lit(identity)))
        self.trail.replace("version_catalog", self.trail.stage(others.unionByName(placed)))
        stored, _ = self.load(identity)
        n, last = stored.agg(F.count("*"), F.max("version_id")).head()
        self._state(identity, str(last), n, VALID)
        return stored

    def _rebuild(self, identity: str, read_all: Callable[[], DataFrame]) -> DataFrame:
        every = self.trail.stage(read_all())
        wrong = problem(every)
        if wrong:
            raise Inconsistent(wrong)
        return self._store(identity, every)

    def synchronise(self, identity: str, read_current: Callable[[], tuple[int, str]], read_all: Callable[[], DataFrame], read_from: Callable[[int], DataFrame]) -> tuple[DataFrame, str]:
        """The catalog after a look at the source, and how it came about: full, local, delta or rebuilt."""
        local, state = self.load(identity)
        if state is None:
            return self._rebuild(identity, read_all), "full"
        if state["status"] != VALID:
            return self._rebuild(identity, read_all), "rebuilt"
        known = local.filter("is_current").head()
        n = local.count()
        if known is None or (str(known["version_id"]), n) != (state["last_current_id"], state["versions"]) or problem(local):
            return self._rebuild(identity, read_all), "rebuilt"
        now = read_current()
        if now == (known["version_id"], known["label"]):
            return local, "local"
        try:
            if now[0] <= known["version_id"]:
                raise Inconsistent("the source went back")
            delta = self.trail.stage(read_from(known["version_id"]))
            wrong = problem(delta)
            first, last = delta.agg(F.min_by(F.struct("version_id", "label"), "version_id"), F.max_by(F.struct("version_id", "label"), "version_id")).head()
            if wrong or tuple(first) != (known["version_id"], known["label"]) or tuple(last) != now:
                raise Inconsistent(wrong or "what came since doesn't follow what is known")
            merged = self.trail.stage(merge_delta(local.select(*[c for c in local.columns if c in delta.columns]), delta, "version_id"))
            wrong = problem(merged)
            if wrong:
                raise Inconsistent(wrong)
        except Inconsistent:
            self._state(identity, state["last_current_id"], state["versions"], FLAGGED)
            return self._rebuild(identity, read_all), "rebuilt"
        return self._store(identity, merged), "delta"
