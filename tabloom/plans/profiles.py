"""Runtime profiles: benchmark samples of how many slots suit a workbook, and what is recommended from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.timing import recommend, sample_weight, usable, valid_sample
from .trail import Trail, upsert

PROFILE = ["identity", "slots", "prefetch", "rate", "confidence"]


def record(trail: Trail, samples: DataFrame) -> DataFrame:
    """Append the valid ones of many samples and renew the profiles of their workbooks; gives these profiles."""
    good = trail.stage(samples.filter(valid_sample(F.col("tasks"), F.col("slots"), F.col("rate"), F.col("prefetch").cast("double"))))
    trail.append("runtime_benchmark", good)
    mine = trail.read("runtime_benchmark").join(good.select("identity").distinct(), "identity", "left_semi")
    renewed = trail.stage(recommend(mine, ["identity"]).select(*PROFILE))
    trail.replace("runtime_profile", trail.stage(upsert(trail.read("runtime_profile"), renewed, ["identity"])))
    return renewed


def load(trail: Trail, identity: str) -> DataFrame:
    """The profile of a workbook, if its numbers can be: 1 to 8 slots, something to prefetch, a usable rate."""
    rows = trail.read("runtime_profile").filter(F.col("identity") == identity)
    return rows.filter(F.col("slots").between(1, 8) & (F.col("prefetch") >= 1) & usable(F.col("rate")))


def prefer(trail: Trail, identity: str, slots: int) -> None:
    """Keep the number of slots that a user chose for a workbook."""
    chosen = trail.spark.createDataFrame([(identity, slots)], "identity string, slots bigint")
    trail.replace("slot_preference", trail.stage(upsert(trail.read("slot_preference"), chosen, ["identity"])))


def running_means(samples: DataFrame, order: str) -> DataFrame:
    """identity, mean: the rate as a running mean keeps it, where stopped runs weigh half. samples(identity, rate, kind, completed)."""
    from ..operators.timing import weighted_running_mean

    entry = F.struct(F.col(order).alias("at"), F.col("rate").alias("v"), (sample_weight(F.lit("normal_run"), F.col("completed"))).alias("w"))
    rows = samples.groupBy("identity").agg(F.array_sort(F.collect_list(entry)).alias("all"))
    return rows.select("identity", weighted_running_mean(F.transform("all", lambda x: x["v"]), F.transform("all", lambda x: x["w"])).alias("mean"))
