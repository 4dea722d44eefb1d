"""The catalog of versions: what is known, what the source says, and how the two are brought together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Inconsistent(ValueError):
    """The source contradicts the catalog: it is read in full again, nothing is dropped."""


def merge_delta(local: DataFrame, delta: DataFrame, order: str) -> DataFrame:
    """The local versions before the last one, then the delta, which begins with that one."""
    anchor = local.agg(F.max(order).alias("_anchor"))
    before = local.join(F.broadcast(anchor), F.col(order) < F.col("_anchor")).drop("_anchor")
    return before.unionByName(delta)


def reconcile(history: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """The history with the current version, in the place of one with the same id."""
    return history.join(current.select(key), key, "left_anti").unionByName(current)


def conflicts(history: DataFrame, current: DataFrame, key: list[str], number: str = "version_id", label: str = "label") -> DataFrame:
    """key and problem of workbooks whose current version contradicts their history.

    The same id under another label, the same label under another id, or an id that is not above all others: the current
    version is then not put into the history.
    """
    own = current.select(*key, F.col(number).alias("_id"), F.col(label).alias("_label"))
    both = history.join(own, key)
    same_id, same_label = F.col(number) == F.col("_id"), F.col(label) == F.col("_label")
    per = both.groupBy(*key).agg(F.bool_or(same_id & ~same_label).alias("a"), F.bool_or(~same_id & same_label).alias("b"), F.bool_or(F.col(number) > F.col("_id")).alias("c"))
    problem = F.when(F.col("a"), "the id has another label").when(F.col("b"), "the label has another id").when(F.col("c"), "the history goes beyond it")
    return per.select(*key, problem.alias("problem")).filter("problem is not null")


def reconciled(history: DataFrame, current: DataFrame, key: list[str], number: str = "version_id", label: str = "label") -> DataFrame:
    """The histories with their current versions; of a workbook with a conflict the history as it was."""
    wrong = conflicts(history, current, key, number, label).select(*key)
    new = current.join(wrong, key, "left_anti")
    return history.join(new.select(*key, number), [*key, number], "left_anti").unionByName(new)


def validation(versions: DataFrame, key: list[str], order: str, current: str) -> DataFrame:
    """Per workbook: versions, whether ids are unique and positive, how many are current, whether that is the last."""
    return versions.groupBy(*key).agg(
        F.count("*").alias("versions"),
        (F.count_distinct(order) == F.count("*")).alias("unique_ids"),
        F.bool_and(F.col(order) > 0).alias("positive"),
        F.count_if(current).alias("current_versions"),
        (F.max(order) == F.max(F.when(F.col(current), F.col(order)))).alias("current_is_last"),
    )


def valid(versions: DataFrame, key: list[str], order: str, current: str) -> bool:
    bad = validation(versions, key, order, current).filter("not (unique_ids and positive and current_versions = 1 and coalesce(current_is_last, false))")
    return not bad.head(1)


def synchronise(local: DataFrame | None, current_id: int, read_all: Callable[[], DataFrame], read_from: Callable[[int], DataFrame], order: str = "version_id") -> tuple[DataFrame, str]:
    """The catalog after a look at the source, and how it came about.

    none: all is read. local: the source's current version is the last known one. delta: what came since is added.
    rebuilt: the source went back, or the delta doesn't begin with the last known version; all is read again.
    """
    known = local.agg(F.max(order)).head()[0] if local is not None else None
    if known is None:
        return read_all(), "full"
    if known == current_id:
        return local, "local"
    if current_id < known:
        return read_all(), "rebuilt"
    delta = read_from(known)
    low, high, n, distinct = delta.agg(F.min(order), F.max(order), F.count("*"), F.count_distinct(order)).head()
    if low != known or high != current_id or n != distinct:
        return read_all(), "rebuilt"
    return merge_delta(local, delta, order), "delta"


def guarded(read_watermark: Callable[[], int], read: Callable[[], DataFrame]) -> DataFrame:
    """A listing during which the source's watermark didn't move."""
    before = read_watermark()
    rows = read()
    if read_watermark() != before:
        raise Inconsistent("the source changed while it was read")
    return rows
