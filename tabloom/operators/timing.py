"""Robust means, rates and estimates over the latest samples of a stage, slot or run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sequences import join_groups, overlapped, running_total

#: Fixed values of the timing model.
SPREAD = 3.0 * 1.4826
STAGE_WINDOW, SLOT_WINDOW, COMMIT_WINDOW = 20, 15, 20
RATE_ALPHA, ETA_ALPHA, LEAST_COMMITS = 0.25, 0.20, 5
#: Values that a smoothed one is made of: the weight of older ones, 0.8 ** 256 at most, is below 1e-24.
SMOOTHED = 256
TIE, DRIFT = 0.05, 1.75


def bound(x: Column, use) -> Column:
    """use(x), with x worked out once: a column in a lambda is else worked out for every element."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def median_of(values: Column) -> Column:
    """The median of an array; F.median takes no frame."""
    middle = lambda s, i: F.get(s, F.floor(i).cast("int"))
    return bound(F.array_sort(values), lambda s: (middle(s, (F.size(s) - 1) / 2) + middle(s, F.size(s) / 2)) / 2)


def mean_of(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)


def _bounded(values: Column, low: Column, high: Column) -> Column:
    return bound(F.struct(low.alias("low"), high.alias("high")), lambda b: mean_of(F.transform(values, lambda x: F.least(F.greatest(x, b["low"]), b["high"]))))


def _with_median(values: Column, use) -> Column:
    """use(median, median of the absolute deviations from it)."""
    return bound(median_of(values), lambda m: bound(median_of(F.transform(values, lambda x: F.abs(x - m))), lambda mad: use(m, mad)))


def usable(x: Column) -> Column:
    """Durations that are finite and not negative."""
    return x.isNotNull() & ~F.isnan(x) & (x >= 0) & (x != float("inf"))


def winsorised_mean(values: Column) -> Column:
    """Plain under three values; else bounded by the median and its absolute deviation, or by a cap where that is 0."""

    def robust(m, mad):
        cap = F.greatest(m * 3.0, m + 1.0)
        return F.when(mad == 0, _bounded(values, F.lit(float("-inf")), cap)).otherwise(_bounded(values, m - SPREAD * mad, m + SPREAD * mad))

    return F.when(F.size(values) < 3, mean_of(values)).otherwise(_with_median(values, robust))


def slot_mean(values: Column) -> Column:
    """As winsorised_mean, with a spread of at least a second."""

    def robust(m, mad):
        spread = F.greatest(F.lit(1.0), SPREAD * mad)
        return _bounded(values, m - spread, m + spread)

    return F.when(F.size(values) < 3, mean_of(values)).otherwise(_with_median(values, robust))


def rolling(rows: DataFrame, key: list[str], order: list[str], value: str, window: int = STAGE_WINDOW, mean=winsorised_mean) -> DataFrame:
    """rows with robust: the robust mean of the latest window usable values. A hot key is many groups."""
    dealt = overlapped(rows.filter(usable(F.col(value))), key, order, window - 1)
    w = Window.partitionBy(*key, "_block").orderBy("_n").rowsBetween(-(window - 1), 0)
    # The frame's array is bound before it is used several times.
    return dealt.withColumn("_last", F.collect_list(value).over(w)).filter("_own").withColumn("robust", mean(F.col("_last"))).select(*rows.columns, "robust")


def throughput(rows: DataFrame, key: list[str], order: list[str], seconds: str, window: int = COMMIT_WINDOW) -> DataFrame:
    """rows with rate: commits a minute over the latest window commits; null until time has passed. A hot key is many groups."""
    dealt = overlapped(rows, key, order, window - 1)
    w = Window.partitionBy(*key, "_block").orderBy("_n").rowsBetween(-(window - 1), 0)
    span = F.col(seconds) - F.first(seconds).over(w)
    rated = dealt.withColumn("rate", F.when(span > 0, (F.count("*").over(w) - 1) * 60.0 / span))
    return rated.filter("_own").select(*rows.columns, "rate")


def latest_rows(rows: DataFrame, key: list[str], order: list[str], n: int) -> DataFrame:
    """The last n rows of each key; each task keeps its own last n before they meet."""
    w = Window.partitionBy(*key).orderBy(*[F.desc(o) for o in order])
    return rows.withColumn("_last", F.row_number().over(w)).filter(F.col("_last") <= n).drop("_last")


def smoothed(values: Column, alpha: float) -> Column:
    """The exponentially weighted mean of an array in its order; nulls are passed over."""
    return F.aggregate(values, F.lit(None).cast("double"), lambda a, x: F.when(x.isNull(), a).when(a.isNull(), x).otherwise(alpha * x + (1 - alpha) * a))


def smoothed_rates(rows: DataFrame, key: list[str], order: list[str], rate: str = "rate", alpha: float = RATE_ALPHA) -> DataFrame:
    """Per key: the smoothed rate after all its rows, from its last SMOOTHED rates: older ones weigh less than rounding."""
    counts = rows.groupBy(*key).agg(F.count("*").alias("commits"))
    last = latest_rows(rows.filter(F.col(rate).isNotNull()), key, order, SMOOTHED)
    entry = F.struct(*order, F.col(rate).alias("_rate"))
    means = last.groupBy(*key).agg(smoothed(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["_rate"]), alpha).alias("smoothed"))
    return join_groups(counts, means, key, "left")


def smoothed_etas(rows: DataFrame, key: list[str], order: list[str], remaining: str, rate: str = "rate") -> DataFrame:
    """Per key: the seconds left that are shown after all its rows: the smoothed estimate, or the last valid one.

    Each row is a commit with what remains after it. Rates are smoothed first; from LEAST_COMMITS commits on each gives an
    estimate, and these are smoothed. Nothing left is an estimate of 0.
    """
    numbered = throughput_counts(rows, key, order)
    last = latest_rows(numbered, key, order, 2 * SMOOTHED)
    entry = F.struct(*order, F.col(rate).cast("double").alias("rate"), F.col(remaining).cast("double").alias("left"), F.col("_n").alias("n"))

    def step(s, x):
        r = F.when(x["rate"].isNull(), s["rate"]).when(s["rate"].isNull(), x["rate"]).otherwise(RATE_ALPHA * x["rate"] + (1 - RATE_ALPHA) * s["rate"])
        raw = x["left"] * 60.0 / r
        new = F.when(s["eta"].isNull(), raw).otherwise(ETA_ALPHA * raw + (1 - ETA_ALPHA) * s["eta"])
        shown = F.when(x["left"] <= 0, F.lit(0.0)).when((x["n"] >= LEAST_COMMITS) & (r > 0), new).otherwise(s["eta"])
        return F.struct(r.alias("rate"), shown.alias("eta"))

    none = F.lit(None).cast("double")
    folded = F.aggregate(F.array_sort(F.collect_list(entry)), F.struct(none.alias("rate"), none.alias("eta")), step, lambda s: s["eta"])
    return last.groupBy(*key).agg(folded.alias("eta"))


def throughput_counts(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """rows with _n: which commit of its key each is, from 1."""
    return running_total(rows, key, order, F.lit(1).cast("bigint"), "_n")


def eta(remaining: Column, rate: Column, commits: Column, mean: Column, slots: Column) -> Column:
    """Seconds left: by the rate from three commits on, else by the mean task and the slots."""
    return F.when(remaining <= 0, 0.0).when((commits >= 3) & rate.isNotNull(), remaining / rate * 60.0).otherwise(remaining * mean / F.greatest(F.lit(1), slots))


def task_mean(total: Column, stages: list[Column], baseline: float) -> Column:
    known = F.coalesce(*[s.isNotNull() for s in stages]) if len(stages) == 1 else F.greatest(*[s.isNotNull() for s in stages])
    return F.coalesce(total, F.when(known, sum((F.coalesce(s, F.lit(0.0)) for s in stages), F.lit(0.0))), F.lit(baseline))


def stage_fraction(ratio: Column) -> Column:
    """Nine tenths at the expected time, then a tail that never ends."""
    return F.least(F.when(ratio <= 1, 0.9 * ratio).otherwise(0.9 + 0.1 * (1 - F.exp(-(ratio - 1)))), F.lit(0.999))


def trailing_count(rows: DataFrame, key: list[str], seconds: str, span: int = 60) -> DataFrame:
    """rows with recent: rows in the span of seconds up to each."""
    w = Window.partitionBy(*key).orderBy(seconds).rangeBetween(-span, 0)
    return rows.withColumn("recent", F.count("*").over(w))


def nearest_rank(values: Column, fraction: float) -> Column:
    """sorted[min(n - 1, floor(n * fraction))] of a short array; summary() takes columns of any length."""
    n = F.size(values)
    return F.get(F.array_sort(values), F.least(n - 1, F.floor(n * fraction).cast("int")))


def summary(rows: DataFrame, key: list[str], value: str, fraction: float = 0.95) -> DataFrame:
    """key, p95, median, mean, low, high of the values that are not null; p95 is sorted[min(n - 1, floor(n * fraction))].

    Equal values are counted first and ranks are found in running counts of distinct values, so no task holds a key.
    """
    v = rows.filter(F.col(value).isNotNull()).groupBy(*key, F.col(value).alias("_v")).agg(F.count("*").alias("_times"))
    placed = running_total(v, key, ["_v"], F.col("_times"), "_to")
    total = v.groupBy(*key).agg(F.sum("_times").alias("_n"), (F.sum(F.col("_v") * F.col("_times")) / F.sum("_times")).alias("mean"), F.min("_v").alias("low"), F.max("_v").alias("high"))
    n = F.col("_n")
    holds = lambda rank: (F.col("_to") > rank) & (F.col("_to") - F.col("_times") <= rank)
    at = lambda rank: F.max(F.when(holds(rank), F.col("_v")))
    both = join_groups(placed, total, key)
    return both.groupBy(*key, "mean", "low", "high").agg(at(F.least(n - 1, F.floor(n * fraction))).alias("p95"), ((at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2).alias("median")).select(*key, "p95", "median", "mean", "low", "high")


def sample_weight(kind: Column, completed: Column) -> Column:
    return F.when(kind == "benchmark_run", 2.0).otherwise(1.0) * F.when(completed, 1.0).otherwise(0.5)


def recommend(samples: DataFrame, key: list[str]) -> DataFrame:
    """Per key the slots to use: of those within 5 % of the best weighted rate, the fewest; with the confidence.

    samples(key, slots, rate, prefetch, kind, completed, comparable).
    """
    w, b = sample_weight(F.col("kind"), F.col("completed")), F.when(F.col("kind") == "benchmark_run", 2.0).otherwise(1.0)
    rates = samples.filter("comparable").groupBy(*key, "slots").agg((F.sum(F.col("rate") * w) / F.sum(w)).alias("rate"), F.count("*").alias("samples"), F.round(F.sum(F.col("prefetch") * b) / F.sum(b)).cast("bigint").alias("prefetch"))
    peak = rates.groupBy(*key).agg(F.max("rate").alias("peak"))
    best = rates.join(peak, key).filter(F.col("rate") >= F.col("peak") * (1 - TIE)).groupBy(*key).agg(F.min_by(F.struct("slots", "rate", "samples", "prefetch"), "slots").alias("r")).select(*key, "r.*")
    return best.withColumn("confidence", F.when(F.col("samples") >= 4, "HIGH").when(F.col("samples") >= 2, "MEDIUM").otherwise("LOW"))


def valid_sample(tasks: Column, slots: Column, *numbers: Column) -> Column:
    good = (tasks >= 20) & slots.between(1, 8)
    for n in numbers:
        good &= usable(n)
    return F.coalesce(good, F.lit(False))


def drifted(old: Column, new: Column) -> Column:
    return (F.least(old, new) > 0) & (F.greatest(old, new) / F.least(old, new) >= DRIFT)


def weighted_running_mean(values: Column, weights: Column) -> Column:
    """The mean as it is updated sample by sample: the divisor grows by the weight, the kept count by one."""
    start = F.struct(F.lit(0.0).alias("mean"), F.lit(0).alias("n"))
    step = lambda s, i: F.struct(((s["mean"] * s["n"] + F.get(values, i) * F.get(weights, i)) / (s["n"] + F.get(weights, i))).alias("mean"), (s["n"] + 1).alias("n"))
    return F.when(F.size(values) > 0, F.aggregate(F.sequence(F.lit(0), F.size(values) - 1), start, step, lambda s: s["mean"]))


def prefetch_target(slots: Column, bytes_: Column) -> Column:
    """Versions to fetch ahead: fewer of large files."""
    return F.when(bytes_ >= 100 << 20, F.least(slots, F.lit(2))).when(bytes_ >= 20 << 20, slots).otherwise(2 * slots)


def scheduler_window(slots: Column) -> Column:
    return slots + 2 * slots
