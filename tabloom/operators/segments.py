"""The alignment of long axes, walked in many tasks: the result is that of one walk from the beginning.

The walk of alignment.align() depends on where it stands, (i, j), and on what lies ahead, and on nothing behind it. So it
can be begun anywhere: if the one walk ever comes to the place where another was begun, from there on they are the same.
Places are guessed where profiles that occur once on each side meet, one for each segment of the base axis, at the shift
that most of the segment's have. Each place is walked from, in a task of its own, over a slice of both axes, until the
walk comes to the place that another was begun at, or out of its slice. Then the pieces are put together from (0, 0): a
piece that ends where another begins is followed by it; one that ends elsewhere is gone on with in another round, in which
only such ends are walked from. A wrong guess costs a piece that is not used, never another result.

The driver sees a few numbers for each segment of axes that are longer than one; shorter axes are a task's each.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .alignment import AHEAD, step
from .sequences import running_total

#: Places of the base axis in a segment; a slice has SLICE segments of either axis.
SEGMENT, SLICE = 2000, 3


def _starts(base: DataFrame, other: DataFrame, key: list[str], segment: int) -> DataFrame:
    """key, i, j: places to begin at, one for each segment that has profiles that occur once on both sides, and (0, 0)."""
    once = lambda t, n: t.groupBy(*key, F.xxhash64("profile").alias("_h")).agg(F.count("*").alias("_n"), F.first(n).alias(n)).filter("_n = 1").drop("_n")
    meet = once(base, "i").join(once(other, "j"), [*key, "_h"]).withColumn("_s", F.floor(F.col("i") / segment)).withColumn("_d", F.col("j") - F.col("i"))
    shifts = meet.groupBy(*key, "_s", "_d").agg(F.count("*").alias("_n"), F.min("i").alias("i"))
    best = shifts.groupBy(*key, "_s").agg(F.max(F.struct("_n", (-F.col("i")).alias("_i"), "_d")).alias("x")).filter("_s > 0")
    found = best.select(*key, (-F.col("x._i")).alias("i"), (F.col("x._d") - F.col("x._i")).alias("j"))
    zero = base.select(*key).distinct().withColumns({"i": F.lit(0).cast("bigint"), "j": F.lit(0).cast("bigint")})
    return found.unionByName(zero)


def _walked(base: DataFrame, other: DataFrame, starts: DataFrame, known: DataFrame, key: list[str], segment: int) -> DataFrame:
    """key, i0, j0 (the start), base_pos, eval_pos of each pair; and a row without a pair, with the place the walk came to."""
    stops = known.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("i", "j"))).alias("_all"))  # a place for each segment
    begun = starts.select(*key, F.col("i").alias("i0"), F.col("j").alias("j0")).join(stops, key)
    reach = segment * SLICE
    begun = begun.withColumn("stops", F.filter("_all", lambda x: (x["i"] > F.col("i0")) & (x["i"] <= F.col("i0") + reach))).drop("_all")

    def slice_of(t: DataFrame, n: str, at: str) -> DataFrame:
        # A row lies in slices that begin in its own block of reach places or in the one before.
        blocks = begun.withColumn("_b", F.explode(F.array(F.floor(F.col(at) / reach), F.floor(F.col(at) / reach) + 1)))
        rows = t.withColumn("_b", F.floor(F.col(n) / reach)).join(blocks, [*key, "_b"])
        return rows.filter((F.col(n) >= F.col(at)) & (F.col(n) < F.col(at) + reach)).select(*[F.col(n if c == "n" else c).alias(c) for c in (*key, "i0", "j0", "n", "pos", "profile", "size", "stops")])

    group = [*key, "i0", "j0"]
    kinds = dict(base.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in key), "i0 bigint, j0 bigint, base_pos bigint, eval_pos bigint, end_i bigint, end_j bigint, ended boolean"])

    def run(k, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        i0, j0 = int(k[-2]), int(k[-1])
        sides = []
        for d in (a, b):
            d = d.sort_values("n")
            sides.append((d["pos"].tolist(), [list(p) for p in d["profile"]], int(d["size"].iloc[0]) if len(d) else None))
        (at, here, n), (to, there, m) = sides
        places = {(int(s["i"]), int(s["j"])) for s in a["stops"].iloc[0]} if len(a) else set()
        i = j = 0
        pairs: list[tuple[int, int]] = []
        # An axis without a row in the slice has ended.
        ended = n is None or m is None
        while not ended:
            if i0 + i >= n or j0 + j >= m:
                ended = True
                break
            if (i or j) and (i0 + i, j0 + j) in places:
                break
            if (i + AHEAD >= len(here) and i0 + len(here) < n) or (j + AHEAD >= len(there) and j0 + len(there) < m):
                break
            down, right = step(here, there, i, j)
            if not down or not right:
                i, j = i + down, j + right
                continue
            pairs.append((at[i], to[j]))
            i, j = i + 1, j + 1
        out = pd.DataFrame({"base_pos": [p for p, _ in pairs] + [None], "eval_pos": [q for _, q in pairs] + [None]}, dtype="Int64")
        out["i0"], out["j0"], out["ended"] = i0, j0, ended
        out["end_i"] = pd.array([None] * len(pairs) + [i0 + i], "Int64")
        out["end_j"] = pd.array([None] * len(pairs) + [j0 + j], "Int64")
        for name, value in zip(key, k, strict=False):
            out[name] = value
        return out[[*key, "i0", "j0", "base_pos", "eval_pos", "end_i", "end_j", "ended"]]

    return slice_of(base, "i", "i0").groupBy(*group).cogroup(slice_of(other, "j", "j0").groupBy(*group)).applyInPandas(run, schema)


def aligned_in_segments(base: DataFrame, other: DataFrame, key: list[str], stage: Callable[[DataFrame], DataFrame], segment: int = SEGMENT) -> DataFrame:
    """key, base_pos, eval_pos of profiles (key, pos, profile), as alignment.aligned() gives them. stage writes a table and reads it.

    Keys must not be null. A key that one side lacks has no rows.
    """
    spark = base.sparkSession
    if segment < 2 * AHEAD:
        raise ValueError("a segment must be longer than what a walk looks ahead")

    def numbered(t: DataFrame, name: str) -> DataFrame:
        own = running_total(t.select(*key, F.col("pos").cast("bigint").alias("pos"), "profile"), key, ["pos"], F.lit(1).cast("bigint"), "_n").withColumn(name, F.col("_n") - 1).drop("_n")
        return stage(own.join(t.groupBy(*key).agg(F.count("*").alias("size")), key))

    b, o = numbered(base, "i"), numbered(other, "j")
    starts = stage(_starts(b, o, key, segment).join(o.select(*key).distinct(), key, "left_semi"))
    walked = stage(_walked(b, o, starts, starts, key, segment))
    ends = lambda t: t.filter("end_i is not null").select(*key, "i0", "j0", "end_i", "end_j", "ended")
    # Of axes that one walk came to the end of, the driver needs to know nothing.
    long = ends(walked).join(ends(walked).filter("i0 = 0 and j0 = 0 and ended").select(*key), key, "left_anti")
    follows: dict[tuple, dict[tuple, tuple]] = {}
    for r in long.collect():
        follows.setdefault(tuple(r[k] for k in key), {})[r["i0"], r["j0"]] = (r["end_i"], r["end_j"], r["ended"])
    schema = ", ".join([*(f"{k} {dict(base.dtypes)[k]}" for k in key), "i bigint", "j bigint"])
    used: set[tuple] = set()
    open_ = {k: (0, 0) for k in follows}
    while open_:
        missing = []
        for k, at in list(open_.items()):
            while at in follows[k]:
                used.add((*k, *at))
                i, j, ended = follows[k][at]
                if ended:
                    del open_[k]
                    break
                at = (i, j)
            else:
                open_[k] = at
                missing.append((*k, *at))
        if missing:
            more = stage(_walked(b, o, spark.createDataFrame(missing, schema), starts, key, segment))
            for r in ends(more).collect():
                follows[tuple(r[k] for k in key)][r["i0"], r["j0"]] = (r["end_i"], r["end_j"], r["ended"])
            walked = walked.unionByName(more)
    whole = ends(walked).filter("i0 = 0 and j0 = 0 and ended").select(*key, F.lit(0).cast("bigint").alias("i0"), F.lit(0).cast("bigint").alias("j0"))
    if used:
        whole = whole.unionByName(spark.createDataFrame(sorted(used), schema).withColumnsRenamed({"i": "i0", "j": "j0"})).distinct()
    pairs = stage(walked.filter("base_pos is not null").join(whole, [*key, "i0", "j0"], "left_semi").select(*key, "base_pos", "eval_pos"))
    # The mapping holds only if one shift other than 0 occurs twice; else equal positions are paired.
    shift = F.col("eval_pos") - F.col("base_pos")
    holds = pairs.filter(shift != 0).groupBy(*key, shift.alias("_d")).agg(F.count("*").alias("_n")).filter("_n > 1").select(*key).distinct()
    same = b.select(*key, F.col("pos").alias("base_pos")).join(o.select(*key, F.col("pos").alias("base_pos")), [*key, "base_pos"]).withColumn("eval_pos", F.col("base_pos"))
    return pairs.join(holds, key, "left_semi").unionByName(same.join(holds, key, "left_anti"))
