"""Ordered sequences of versions, pairs and commits: windows over one workbook's rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Rows of a range of running_total(), about, and the most ranges; they are cut at a sample of SAMPLED values.
RANGE_ROWS, RANGES, SAMPLED = 1 << 16, 4096, 1 << 15
#: Rows of a block of overlapped().
BLOCK = 8192


def range_of(value: Column, bounds: list) -> Column:
    """How many of the sorted bounds are not above a value, in two steps; 0 for null."""
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    if not groups:
        return F.lit(0)
    at_or_below = lambda values: F.size(F.filter(values, lambda b: b <= value))
    coarse = at_or_below(F.array(*[F.lit(g[0]) for g in groups]))
    fine = at_or_below(F.get(F.array(*[F.array(*map(F.lit, g)) for g in groups]), coarse - 1))
    return F.when(value.isNull() | (coarse == 0), 0).otherwise((coarse - 1) * step + fine)


def join_groups(left: DataFrame, right: DataFrame, key: list[str], how: str = "inner") -> DataFrame:
    """Join on a key whose nulls are a group too."""
    other = right.select(*[F.col(k).alias(f"_{k}_right") for k in key], *[c for c in right.columns if c not in key])
    on = F.lit(True)
    for k in key:
        on &= F.col(k).eqNullSafe(F.col(f"_{k}_right"))
    return left.join(other, on, how).drop(*[f"_{k}_right" for k in key])


def running_total(rows: DataFrame, key: list[str], order: list[str], amount: Column, name: str, range_rows: int | None = None) -> DataFrame:
    """rows with name: the sum of amount over the rows of their key up to them, in an order without ties.

    No task holds a key: sums within ranges of the first column of the order are added to the totals of the ranges
    before. The ranges are cut at values that are chosen by their hash, so a run again cuts alike.
    """
    count = min(RANGES, max(1, rows.count() // (range_rows or RANGE_ROWS)))
    found = sorted(r[0] for r in rows.select(order[0]).filter(F.col(order[0]).isNotNull()).orderBy(F.xxhash64(order[0])).limit(SAMPLED).collect()) if count > 1 else []
    bounds = sorted({found[i * len(found) // count] for i in range(1, count)}) if found else []
    ranged = rows.withColumn("_range", range_of(F.col(order[0]), bounds)).withColumn("_amount", amount)
    totals = ranged.groupBy(*key, "_range").agg(F.sum("_amount").alias("_total"))
    # A row for each key and range.
    before = Window.partitionBy(*key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ahead = totals.select(*[F.col(k).alias(f"_{k}_") for k in key], F.col("_range").alias("_at"), F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_ahead"))
    inside = Window.partitionBy(*key, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    on = F.col("_range") == F.col("_at")
    for k in key:
        on &= F.col(k).eqNullSafe(F.col(f"_{k}_"))
    own = ranged.withColumn("_in", F.sum("_amount").over(inside))
    return own.join(ahead, on).withColumn(name, F.col("_in") + F.col("_ahead")).select(*rows.columns, name)


def overlapped(rows: DataFrame, key: list[str], order: list[str], back: int, block: int | None = None) -> DataFrame:
    """rows with _n (their number in their key, from 0), _block and _own: blocks of rows, with the back rows before each.

    A frame of up to back rows before a row lies in the row's own block, so a hot key is many groups. Rows that are not
    _own are there for frames only.
    """
    block = max(block or BLOCK, back)
    n = F.col("_n")
    numbered = running_total(rows, key, order, F.lit(1).cast("bigint"), "_n").withColumn("_n", n - 1)
    home = F.floor(n / block)
    blocks = F.when(n % block >= block - back, F.array(home, home + 1)).otherwise(F.array(home))
    return numbered.withColumn("_block", F.explode(blocks)).withColumn("_own", F.col("_block") == F.floor(n / block))


def consecutive_pairs(versions: DataFrame, key: list[str], order: str) -> DataFrame:
    """(key, previous, current) of neighbouring versions."""
    w = Window.partitionBy(*key).orderBy(order)
    return versions.select(*key, F.col(order).alias("previous"), F.lead(order).over(w).alias("current")).filter("current is not null")


def slice_interval(versions: DataFrame, order: Column, start=None, end=None) -> DataFrame:
    """Versions between two ids, both included; None leaves a side open."""
    inside = F.lit(True)
    if start is not None:
        inside &= order >= start
    if end is not None:
        inside &= order <= end
    return versions.filter(inside)


def resolve_interval(versions: DataFrame, order: Column, start=None, end=None) -> DataFrame:
    """slice_interval(), but refused where it would be silent: equal ids, ends that no version has, fewer than two versions."""
    is_end = lambda v: F.count_if(order == F.lit(v)) if v is not None else F.lit(1)
    n, ids, low, high, first, last = versions.agg(F.count("*"), F.count_distinct(order), F.min(order), F.max(order), is_end(start), is_end(end)).head()
    if n < 2:
        raise ValueError("fewer than two versions are known")
    if ids < n:
        raise ValueError("two versions have one id, or one has none")
    for at, there in ((start, first), (end, last)):
        if not there:
            raise ValueError(f"no version has the id {at}")
    if (low if start is None else start) >= (high if end is None else end):
        raise ValueError("an interval must be in order and hold two versions")
    return slice_interval(versions, order, start, end)


def islands(pairs: DataFrame, key: list[str], pos: str, covered: str) -> DataFrame:
    """Runs of pairs with the same state: key, covered, first, last, pairs."""
    w = Window.partitionBy(*key).orderBy(pos)
    turn = F.coalesce((F.col(covered) != F.lag(covered).over(w)).cast("int"), F.lit(1))
    run = F.sum("turn").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return pairs.withColumn("turn", turn).withColumn("run", run).groupBy(*key, "run", covered).agg(F.min(pos).alias("first"), F.max(pos).alias("last"), F.count("*").alias("pairs"))


def covered_prefix(pairs: DataFrame, key: list[str], pos: str, covered: str) -> DataFrame:
    """The length and end of the longest covered prefix: null end where the first pair is open."""
    w = Window.partitionBy(*key).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    own = F.min(F.col(covered).cast("int")).over(w)
    return pairs.withColumn("whole", own).groupBy(*key).agg(F.sum("whole").alias("prefix"), F.max(F.when(F.col("whole") == 1, F.col(pos))).alias("checkpoint"))


def checkpoint_targets(pairs: DataFrame, key: list[str], pos: str, covered: str) -> DataFrame:
    """For each open pair, where the checkpoint goes once it is done: past the covered pairs up to the next open one."""
    w = Window.partitionBy(*key).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    group = F.sum((~F.col(covered)).cast("int")).over(w)
    return pairs.withColumn("gap", group).filter("gap > 0").groupBy(*key, "gap").agg(F.min(pos).alias("open"), F.max(pos).alias("target"))


def coverage(requested: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Requested pairs with covered: those that are among the done ones."""
    return requested.join(done.select(*key).distinct().withColumn("covered", F.lit(True)), key, "left").withColumn("covered", F.coalesce("covered", F.lit(False)))


def coverage_counts(pairs: DataFrame, key: list[str], covered: str = "covered") -> DataFrame:
    percent = F.when(F.count("*") == 0, 100.0).otherwise(100.0 * F.count_if(covered) / F.count("*"))
    return pairs.groupBy(*key).agg(F.count("*").alias("requested"), F.count_if(covered).alias("covered"), F.count_if(~F.col(covered)).alias("missing"), percent.alias("percent"))


def monotonic(rows: DataFrame, key: list[str], order: str, value: str) -> DataFrame:
    """Per key: rows, distinct values, and whether values ascend strictly in the given order."""
    w = Window.partitionBy(*key).orderBy(order)
    up = F.coalesce(F.col(value) > F.lag(value).over(w), F.lit(True))
    return rows.withColumn("up", up).groupBy(*key).agg(F.count("*").alias("n"), F.count_distinct(value).alias("distinct_values"), F.bool_and("up").alias("ascending"))


def contiguous(rows: DataFrame, key: list[str], seq: str) -> DataFrame:
    """Staged results that can be committed now: those whose sequence has no gap before it, from 1."""
    w = Window.partitionBy(*key).orderBy(seq)
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") == F.col(seq)).drop("place")


def sheets(rows: DataFrame, order: str, per_sheet: int) -> DataFrame:
    """rows with seq and sheet_no: row numbers in the order of a unique column, and the sheet of each.

    A row without a place in the order is refused. Numbers are running totals over ranges of the column that are cut at
    sampled values, so no task holds all rows, however the values lie.
    """
    if rows.filter(F.col(order).isNull()).head(1):
        raise ValueError(f"a row has no {order}")
    numbered = running_total(rows, [], [order], F.lit(1).cast("bigint"), "seq")
    return numbered.withColumn("sheet_no", (F.floor((F.col("seq") - 1) / per_sheet) + 1).cast("bigint"))


def latest(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last row of each key."""
    columns = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*columns), order).alias("r")).select(*key, "r.*")


def occurrence(rows: DataFrame, key: list[str], *order: str) -> DataFrame:
    """rows with ordinal: how many rows of the key came before."""
    return rows.withColumn("ordinal", (F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1).cast("bigint"))


def first_per_class(rows: DataFrame, key: list[str], order: list[str], n: int) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")


def high_water(rows: DataFrame, key: list[str], order: str, value: str) -> DataFrame:
    """rows with shown: the greatest value so far, and state: new, current or stale against what was seen before."""
    w = Window.partitionBy(*key).orderBy(order)
    before = F.max(value).over(w.rowsBetween(Window.unboundedPreceding, -1))
    state = F.when(before.isNull() | (F.col(value) > before), "new").when(F.col(value) == before, "current").otherwise("stale")
    return rows.withColumn("shown", F.max(value).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("state", state)


def carried(rows: DataFrame, key: list[str], order: str, value: str) -> DataFrame:
    """rows with carried: the last value that is not null, up to the row."""
    w = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("carried", F.last(value, True).over(w))


def active_clock(rows: DataFrame, key: list[str], order: str, pause: str) -> DataFrame:
    """rows with paused: the pauses before the row, which a clock of active time leaves out."""
    w = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("paused", F.sum(pause).over(w))


def state_time(rows: DataFrame, key: list[str], order: str, seconds: str, holds: str) -> DataFrame:
    """Per key: time until the next row, summed over rows in which a state holds."""
    w = Window.partitionBy(*key).orderBy(order)
    span = F.lead(seconds).over(w) - F.col(seconds)
    return rows.withColumn("span", F.when(F.col(holds), span)).groupBy(*key).agg(F.coalesce(F.sum("span"), F.lit(0)).alias("held"))
